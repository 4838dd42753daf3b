import sys

from spindle.plans.studio import main

sys.exit(main())
