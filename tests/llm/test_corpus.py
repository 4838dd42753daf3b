"""Near duplicates, decontamination, language ID, toxicity, tokens and the pipeline against plain versions."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
import test_spans
from spindle.llm import decontam, langid, ngram_join, pii, sentence_pieces, shared, toxicity
from spindle.llm.shingles import WORD

SMALL = "/root/testdata/sf0.001"


def grams(text):
    words = WORD.findall((text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(rows, threshold=0.8):
    """rows: (doc_id, text) -> {row: (class_id, n_links)}"""
    sets, where = [grams(t) for _, t in rows], defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            where[g].add(i)
    links = [set() for _ in rows]
    for i, s in enumerate(sets):
        for j, both in Counter(j for g in s for j in where[g]).items():
            if j != i and both >= threshold * (len(s) + len(sets[j]) - both) - 1e-9:
                links[i].add(j)
    root = list(range(len(rows)))
    for i in range(len(rows)):
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        root[i] = min(ids) if ids else None
    return [(r, len(x)) for r, x in zip(root, links, strict=True)]


def near_copies(rng, words, n, edits):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("blocks", [(256, 1_000_000), (7, 2000)])
def test_classes_and_links_are_those_of_all_pairs(spark, blocks):
    rng = random.Random(4)
    word = lambda: "w" + str(rng.randrange(5000))
    texts = [None, "", "...", "one", "one", "One!", "two words", "five words are just enough", "a b c d e f", "a b c d e f g"]
    for n, edits in ((40, 1), (12, 3), (30, 2), (5, 0)):
        texts += near_copies(rng, [word() for _ in range(120)], n, edits)
    chain = [word() for _ in range(100)]
    for i in range(0, 60, 4):  # each alike to the next, the ends are not
        texts.append(" ".join([f"c{j}" if j < i else w for j, w in enumerate(chain)]))
    shared_passage = " ".join(word() for _ in range(20))
    texts += [shared_passage + " " + " ".join(word() for _ in range(30)) for _ in range(60)]
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(None, texts[20]), (None, "a text of its own without a name"), (5, texts[30]), (5, texts[30]), (7, "same id other text here is"), (7, "entirely different words in this one")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id bigint, text string, key string, root int").repartition(5)
    got = ngram_join.report(docs.select("doc_id", "text")) if blocks[0] == 256 else ngram_join.classes(docs, block_sets=blocks[0], block_shingles=blocks[1])
    key = lambda x: tuple((v is None, v) for v in x)
    want = sorted(((i, *c) for (i, _), c in zip(rows, brute_classes(rows), strict=True)), key=key)
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()), key=key) == want
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert {i for i in ids if i is not None} == {c for _, c, _ in want if c is not None} and ids[None] == 1 and ids[5] <= 1 and ids[7] == 2


def test_one_row_of_each_class_stays_without_an_id_too(spark):
    rng = random.Random(6)
    a, b, c, d = ([f"{x}{i}" for i in range(100)] for x in "abcd")
    rows = [(3, " ".join(a)), *((None, t) for t in near_copies(rng, a, 3, 1)), *((None, t) for t in near_copies(rng, b, 3, 1)), (None, " ".join(b)), (None, " ".join(b)), (None, None), (None, None), (None, "..."), (8, None), (8, None)]
    rows += [(1, " ".join(c)), (1, " ".join(d)), (0, near_copies(rng, d, 1, 1)[0]), (2, "two words"), (2, "Two words!")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    kept = [(r["doc_id"], (r["text"] or "")[:1]) for r in ngram_join.keep_first(docs).collect()]
    assert Counter((i, t.lower()) for i, t in kept) == Counter({(3, "a"): 1, (None, "b"): 1, (None, ""): 2, (None, "."): 1, (8, ""): 1, (1, "c"): 1, (0, "d"): 1, (2, "t"): 1})


def test_own_documents_link_as_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = ngram_join.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == sorted((i, *c) for (i, _), c in zip(rows, brute_classes(rows), strict=True))


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert ngram_join.report(none).count() == 0 and langid.report(none).count() == 0 and sentence_pieces.report(none).count() == 0
    assert toxicity.report(none, spark.createDataFrame([], "doc_id bigint, toxic int")).count() == 0
    assert decontam.report(none, spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 101)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in shared.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def test_pruning_never_drops_what_the_tolerance_keeps():
    for seen, least in ngram_join.least_matches(0.8, 1e-5):
        assert ngram_join.posterior(least, seen, 0.8) >= 1e-5 and (least == 0 or ngram_join.posterior(least - 1, seen, 0.8) < 1e-5)


def brute_windows(text, items, threshold=0.8):
    words, found = WORD.findall((text or "").lower()), {}
    if len(words) < 5:
        return found
    for i, t in items:
        own = WORD.findall((t or "").lower())
        if i is None or len(own) < 5:
            continue
        n = min(len(own), len(words))
        a = Counter(tuple(own[k : k + 5]) for k in range(len(own) - 4))
        best = 0
        for s in range(len(words) - n + 1):
            b = Counter(tuple(words[k : k + 5]) for k in range(s, s + n - 4))
            both = sum((a & b).values())
            best = max(best, both / (a.total() + b.total() - both))
        if best >= threshold:
            found[i] = best
    return found


def test_contamination_is_that_of_all_windows(spark):
    rng = random.Random(9)
    word = lambda: "b" + str(rng.randrange(300))
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 60)))) for i in range(40)] + [(100, None), (101, ""), (102, "too few words"), (None, "a b c d e f g"), (103, "r " * 30), (104, "same text twice is the same"), (105, "same text twice is the same")]
    texts = [None, "", "a b", "r " * 200, "Same text, TWICE is the same!"]
    for i, t in items[:40]:
        w = t.split()
        head, tail = " ".join(word() for _ in range(rng.randint(0, 50))), " ".join(word() for _ in range(rng.randint(0, 400)))
        texts.append(f"{head} {t} {tail}")
        if len(w) > 30:
            w[rng.choice([0, 1, len(w) - 1, len(w) // 2])] = "other"
            texts.append(f"{head} {' '.join(w)} {tail}")
            texts.append(" ".join(w[: len(w) // 2]))
            texts.append(" ".join(w[1:]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = defaultdict(dict)
    for r in decontam.report(docs, bench).collect():
        got[r["doc_id"]][r["item_id"]] = r["similarity"]
    want = {i: f for i, t in enumerate(texts) if (f := brute_windows(t, items))}
    assert {i: {k: pytest.approx(v) for k, v in f.items()} for i, f in want.items()} == dict(got)
    assert {r["doc_id"] for r in decontam.clean(docs, bench).collect()} == set(range(len(texts))) - set(want)


def test_a_benchmark_in_parts_gives_the_same(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    whole = sorted(map(tuple, decontam.report(docs, bench).collect()))
    monkeypatch.setattr(decontam.parts_of, "__defaults__", (3000,))
    assert sorted(map(tuple, decontam.report(docs, bench).collect())) == whole


def test_simhash_lists_hold_all_within_the_radius():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (400, 16), dtype=np.uint8)
    b = a ^ np.packbits(rng.random((400, 128)) < 0.2, axis=1)
    index = {"ids": list(range(400)), "lists": [decontam.lists(b[:, k]) for k in range(16)]}
    w, i = decontam.Items.candidates(a, index)
    found, within = set(zip(w.tolist(), i.tolist(), strict=True)), decontam.ONES[a[:, None] ^ b[None]].sum(2) <= decontam.RADIUS
    assert within.sum() > 300 and set(zip(*map(np.ndarray.tolist, np.nonzero(within)), strict=True)) <= found
    assert len(found) < 400 + 400 * 400 * 1e-3  # unlike pairs are hardly ever visited


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=9, max_size=40), st.integers(1, 8))
def test_simhash_counts_occurrences(values, n):
    """Windows that slide have the fingerprints of windows taken alone."""
    h = decontam.mix(np.array(values, np.uint64))
    starts = np.arange(len(h) - n + 1)
    slid = decontam.simhash(h, starts, n)
    for s in starts:
        seen, total = Counter(), np.zeros(128, np.int64)
        for x in h[s : s + n]:
            seen[int(x)] += 1
            k = np.uint64(seen[int(x)])
            total += decontam.signs(np.array([x if k == 1 else decontam.mix(np.array([x + k * np.uint64(0x9E3779B97F4A7C15)]))[0]], np.uint64))[0]
        assert (np.packbits(total > 0) == slid[s]).all()


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.report(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 150 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows) and sum(r["rejected"] for r in rows) <= 0.01 * len(rows)


def test_language_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "the and of", "en"), (2, None, "en"), (3, "123 !?", "de"), (4, "the", None), (None, "x", "fr"), (6, "a" * 600_000, "en")], "doc_id bigint, text string, lang string")
    rows = {r["doc_id"]: r for r in langid.report(docs).collect()}
    assert rows[2]["lang_pred"] == rows[3]["lang_pred"] == "und" and rows[2]["score"] == 0 and rows[6]["lang_pred"] != "und"
    assert {r["doc_id"] for r in langid.accepted(docs).collect()} <= {1, 4, None, 6}


def test_languages_of_long_documents_are_learned(spark):
    rng = random.Random(3)
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(i, text("abcdef", 1000), "long") for i in range(60)] + [(100 + i, text("uvwxyz", 20), "short") for i in range(3000)] + [(5000, text("klmno", 1000), "rare"), (5001, text("klmno", 1000), "rare"), (5002, text("klmno", 900), "rare")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    model = langid.train(docs, 200)
    assert model.langs == ["long", "rare", "short"]
    found = langid.report(docs.filter("lang = 'long'")).collect()
    assert {r["lang_pred"] for r in found} == {"long"} and not all(r["rejected"] for r in found)
    assert model.predict(text("abcdef", 2000))[0] == "long" and model.predict(text("uvwxyz", 2000))[0] == "short"
    assert [langid.quota(n, 200) for n in ([60, 3, 3000], [5, 5], [1] * 300, [], [100, 100], [90, 150, 150])] == [137, 5, 1, 1, 100, 66]


def test_toxicity_of_rows_it_has_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = toxicity.report(docs, labels.filter("doc_id % 5 > 0")).join(labels.filter("doc_id % 5 = 0").withColumnRenamed("toxic", "y"), "doc_id").collect()
    hits, toxic, flagged = sum(r["toxic"] and r["y"] for r in found), sum(r["y"] for r in found), sum(r["toxic"] for r in found)
    assert toxic > 50 and hits / toxic > 0.85 and hits / flagged > 0.95


LIBRARY = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
PIECES = sentence_pieces.loaded(LIBRARY.serialized_model_proto())


@settings(max_examples=300, deadline=None)
@given(st.text() | st.lists(st.sampled_from(["the", "ing", " ", "  ", "\n", "▁", "é", "😀", "==", "執", "<s>", "\r", "\0"]), max_size=20).map("".join))
def test_tokens_are_those_of_the_library(text):
    ids = PIECES.encode(text)
    assert np.frombuffer(ids, "<i4").tolist() == LIBRARY.encode(text)
    assert PIECES.decode(ids) == text.replace("▁", " ")


def test_token_columns(spark):
    texts = [None, "", "a  b", "x" * 100_000, " " * 1000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    tokenizer = sentence_pieces.Tokenizer(spark)
    rows = sentence_pieces.tokenized(docs).withColumn("back", tokenizer.decoder()(F.col("token_ids"))).orderBy("doc_id").collect()
    assert [r["back"] for r in rows] == ["", "", *texts[2:]] and all(list(r["token_ids"]) == LIBRARY.encode(r["text"] or "") for r in rows)
    assert all(r["round_trip"] for r in sentence_pieces.report(docs).collect())


def test_a_unigram_model_takes_the_best_sum():
    pieces = sentence_pieces.Pieces.__new__(sentence_pieces.Pieces)
    pieces.ids, pieces.scores, pieces.texts, pieces.merges = {"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4}, [-1.0, -1.5, -2.1, -1.2, -4.0], ["a", "b", "ab", "ba", "aba"], False
    pieces.pairs = {}
    pieces.automaton = sentence_pieces.ahocorasick.Automaton()
    for t, i in pieces.ids.items():
        pieces.automaton.add_word(t, (len(t), i))
    pieces.automaton.make_automaton()
    assert pieces.viterbi("aba") == [0, 3] and pieces.viterbi("ab") == [2]


def test_the_pipeline_does_what_its_stages_say(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rejected = {r["doc_id"] for r in langid.report(docs).filter("rejected").collect()}
    left = [(i, r["text"]) for i, r in rows.items() if i not in rejected]
    left = [(i, t) for (i, t), (c, _) in zip(left, brute_classes(left), strict=True) if i == c]
    left = {i: t for i, t in left if not brute_windows(t, bench)}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(got) == set(left)
    for i, r in got.items():
        text = PIECES.decode(np.asarray(r["token_ids"], "<i4").tobytes())
        assert r["n_chars"] == len(text) and (text == left[i] or "[" in text)


def plain_redaction(text, spans):
    """``text`` with each run of overlapping spans (kind, start, end) as [KIND] of its first."""
    out, reach = "", 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= reach:
            out += text[reach:a] + f"[{kind.upper()}]"
        reach = max(reach, b)
    return out + text[reach:]


def test_personal_data_is_a_plain_redaction(spark):
    odd = test_spans.ODD + ["mail a@b.cd or c@d.ef, card 4111111111111111", "1.2.3.4.5@x.yz", "a@b.cd" * 3, "+1 415 555 0100 4111 1111 1111 1111"]
    given = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "n_chars")
    docs = given.unionByName(spark.createDataFrame([(10_000 + i, t, len(t or "")) for i, t in enumerate(odd)], "doc_id bigint, text string, n_chars bigint").withColumn("n_chars", F.col("n_chars").cast(given.schema["n_chars"].dataType)))
    found = {r["doc_id"]: [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)] for r in pii.report(docs).collect()}
    changed = 0
    for r in corpus_pipeline.personal_data(spark, docs.withColumn("before", F.col("text")), SMALL).collect():
        spans, text = found[r["doc_id"]], r["before"]
        if text is None:
            assert r["text"] is r["n_chars"] is None and not spans
            continue
        assert r["text"] == plain_redaction(text, spans) and r["n_chars"] == len(r["text"])
        base = [s for s in spans if s[0] in ("email", "ip", "card", "phone")]
        if len(text) < 20000:
            assert sorted(base) == sorted(test_spans.brute_pii(text))
        changed += r["text"] != text
    assert changed > 20


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_keep_callers_columns_and_take_odd_rows(spark, stage):
    """Columns named as a stage's own ones, nulls in any column, empty, very long and repeated texts, an empty table."""
    run = dict(corpus_pipeline.STAGES)[stage]
    good = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(text) > 300").orderBy("doc_id").limit(30).collect()]
    langs = [r["lang"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(text) > 300").orderBy("doc_id").limit(30).collect()]
    names = ["__lang", "__items", "pii_spans", "raw", "__id", "__hash", "__turn", "__alone", "__kept_id", "__kept_hash", "token_ids", "n_tokens", "hash", "key", "root", "f", "p"]
    rows = [(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate(zip(good, langs, strict=True))]
    rows += [(100, None, None, None, None), (101, "", "en", "s", 0), (102, "  \n", "en", "s", 3), (None, good[0], langs[0], "s", 5), (None, None, None, None, None), (103, good[1] * 400, langs[1], "s", 9), (3, good[3], langs[3], "s", len(good[3])), (104, "1234 5678", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    out = run(spark, docs, SMALL)
    kept = {c: c for c in docs.columns if c != "text"}
    if stage == "tokens":
        kept |= {"token_ids": "token_ids_input", "n_tokens": "n_tokens_input"}
    else:
        assert out.columns == docs.columns
    got = out.collect()
    assert got and all(r[kept[n]] == f"{n} of {'none' if r['doc_id'] is None else r['doc_id']}" for r in got for n in names)
    ids = Counter(r["doc_id"] for r in got)
    if stage in ("personal_data", "tokens"):
        assert ids == Counter(r[0] for r in rows)
    if stage == "near_duplicates":
        assert ids[3] == 1 and ids[100] == ids[101] == ids[102] == 1 and ids[None] == 1  # the null text without an id; the copy of 0 goes
    if stage == "language_id":
        assert not set(ids) & {100, 101, 102, 104} and ids[3] in (0, 2)
    if stage == "decontamination":
        assert ids[100] == ids[101] == ids[102] == 1 and ids[3] in (0, 2)
    assert run(spark, docs.limit(0), SMALL).count() == 0
