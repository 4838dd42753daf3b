"""Each method against a plain version of itself, on held-out or odd input."""

import base64
import math
import os
import random
import secrets as system
import uuid
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from spindle.llm import chat, langid, pii, secrets, sentence_pieces, shared, topk, toxicity, url_filter


def plain_topk(rows, k, mod=20):
    """Whole numbers of any size; a score beyond a long is the nearest long."""
    vs = [(i, [int(x) * 64 if abs(x) >= 2**52 else math.floor(x * 64) for x in v], v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, w, v in vs:
        if i % mod == 0 and (i not in asked or v < asked[i][0]):
            asked[i] = (v, w)
    out = []
    for own, (_, w) in asked.items():
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(w, x, strict=True)))), i) for i, x, _ in vs if i != own and len(x) == len(w))
        out += [(own, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("k, blocks", [(5, (20, 7)), (20, (50, 10))])
def test_vectors_of_any_size_take_part(spark, k, blocks):
    rng, rows = random.Random(k), []
    kinds = [lambda: [0.5] * 8, lambda: [rng.uniform(-1, 1) for _ in range(8)], lambda: [rng.uniform(-100, 100) for _ in range(8)], lambda: [rng.choice((-1, 1)) * 2.0 ** rng.choice((40, 47, 60, 300, 1000, 1023)) for _ in range(8)], lambda: [0.0] * 8, lambda: [rng.uniform(-1, 1) for _ in range(5)], lambda: [], lambda: [None] + [1.0] * 7, lambda: [float("nan")] * 8, lambda: None, lambda: [float(rng.randint(-2, 2)) for _ in range(8)]]
    for i in range(240):
        rows.append((i if rng.random() < 0.9 else rng.choice((None, 20, 21, 40)), rng.choice(kinds)()))
    rows += [(20, [2.0**40] * 8), (21, [2.0**47] * 8), (22, [2.0**40] * 8)] * 2
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("clash")).repartition(5)
    got = topk.top_k(frame.filter("vec_id % 20 = 0"), frame, k, 64, *blocks)
    assert sorted(map(tuple, got.collect())) == plain_topk(rows, k)


def test_a_chain_predicts_as_its_formula_says():
    rng = np.random.default_rng(3)
    toxic = (rng.random(500) < 0.3).astype(float)
    rows = []
    for y in toxic:
        ids = set(rng.integers(0, 30, 6).tolist()) | ({100 + int(rng.integers(0, 3))} if y and rng.random() < 0.9 else set())
        rows.append((np.array(sorted(ids)), np.log1p(np.ones(len(ids)))))
    model = toxicity.fit(rows, toxic)
    assert len(model.links) == len(toxicity.CHAIN) and [len(v) for _, v, _ in model.links] == list(range(len(toxicity.CHAIN)))
    place = {f: k for k, f in enumerate(model.kept.tolist())}
    for ids, values in rows[:50]:
        before = []
        for w, v, b in model.links:
            z = b + sum(x * w[place[i]] for i, x in zip(ids.tolist(), values, strict=True) if i in place) + sum(a * c for a, c in zip(before, v, strict=True))
            before.append(1 / (1 + math.exp(-z)))
        assert model.predict(ids, values) == pytest.approx(before, abs=1e-9)
    verdict = [model.predict(*r)[-1] >= 0.5 for r in rows]
    cut = toxicity.Model(model.kept, [*model.links[:-1], (model.links[-1][0], 0 * model.links[-1][1], model.links[-1][2])])
    assert np.mean(np.array(verdict) == (toxic > 0)) > 0.95
    assert max(abs(model.predict(*r)[-1] - cut.predict(*r)[-1]) for r in rows) > 0.1  # the verdict rests on earlier links
    assert toxicity.fold_of(rows[0][0]) == toxicity.fold_of(rows[0][0].copy()) and toxicity.fit([], np.empty(0)).predict(np.empty(0, np.int64), np.empty(0)) == [0.0] * 4


def test_toxicity_of_odd_rows(spark):
    rng = random.Random(2)
    text = lambda bad: " ".join(rng.choice(("sun", "rain", "tree", "house", "river", "stone")) for _ in range(20)) + (" awful nasty" if bad else "")
    rows = [(i, text(i % 4 == 0), 1) for i in range(400)] + [(1000, None, 1), (1001, "", 1), (1002, "awful nasty " * 20_000, 1), (1003, "awful nasty sun", 1), (1003, "awful nasty sun", 1), (None, "sun", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").withColumn("p_toxic", F.lit("x")).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(5, None), (7, 0), (7, 1), (None, 1)], "doc_id bigint, toxic int")
    found = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows) and by[1003]["toxic"] is True and by[1002]["toxic"] is True and not by[1000]["toxic"] and not by[1001]["toxic"]
    assert by[1003]["toxic_input"] == 1 and by[1003]["p_toxic_input"] == "x" and sum(r["toxic"] for r in found if r["doc_id"] is not None and r["doc_id"] < 400) == 100


def test_languages_are_predicted_as_the_formula_says():
    def plain(text):
        hits = Counter()
        line = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        for n in langid.GRAMS:
            for i in range(len(line) - n + 1):
                g = line[i : i + n]
                if (n == 1 and g == " ") or (n > 1 and (" " in g[1:-1] or (g[0] == " " and g[-1] == " "))):
                    continue
                h = (n * 97) & 0xFFFFFFFF
                for k, c in enumerate(g):
                    h = ((h ^ ord(c)) * int(langid._MULT[k])) & 0xFFFFFFFF
                    h ^= h >> 15
                hits[h % langid.BUCKETS] += 1
        return hits

    rng = np.random.default_rng(1)
    model = langid.Model(["a", "b", "c"], rng.standard_normal((langid.BUCKETS, 3)), rng.standard_normal(3), 0.4)
    for text in ("Hello, world 12", "ÄÖ ß x", "漢字 かな 😀 ½ ok", "a" * 50, "x y z"):
        hits = plain(text)
        z = sum(n * model.table[b] for b, n in hits.items()) / sum(hits.values()) + model.bias
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        lang, score, rejected = model.predict(text)
        assert lang == model.langs[int(p.argmax())] and score == pytest.approx(p.max()) and rejected == (p.max() < 0.4)
    assert all(model.predict(t) == ("und", 0.0, True) for t in (None, "", "½", "x²"[1:], "12 ³", "😀 🎉", "　", "Ⅷ", "①"))
    assert model.predict("々")[0] != "und" and model.predict("𝔘")[0] != "und"


def test_the_url_model_knows_hosts_it_has_not_seen(spark):
    bad = ["m.casino-win.example.com", "free-bets.example.com", "ads-track.example.com", "spam-farm.example.com", "cheap-pills.example.com", "adult-x.example.net"]
    seen = {h for h, _, _ in url_filter.labelled()}
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    rows = url_filter.report(pages.filter("url NOT RLIKE '/(de|es)/|com/en/|example.com/en/7'")).collect()
    planted = [r for r in rows if any(r["host"].endswith(b.removeprefix("m.")) for b in bad)]
    other = [r for r in rows if not any(r["host"].endswith(b.removeprefix("m.")) for b in bad)]
    assert not seen & {r["host"] for r in rows} and len(planted) > 20 and len(other) > 300
    assert sum(r["verdict"] == "block" for r in planted) / len(planted) > 0.9 and sum(r["verdict"] == "block" for r in other) / len(other) < 0.02


def test_urls_of_odd_tables(spark):
    rows = [(1, "https://a.b/" + "x" * 100_000), (1, "https://a.b/" + "x" * 100_000), (None, None), (2, "https://casino-poker-bets.example.com/free-casino")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string").withColumns({"url_host": F.lit("h"), "total": F.lit(1), "fits": F.lit(2)})
    got = url_filter.judge(frame)
    assert set(got.columns) >= {"url_host_input", "total", "fits"} and got.count() == 4
    assert [r["url_verdict"] for r in got.filter("page_id = 2").collect()] == ["block"] and {r["fits"] for r in got.collect()} == {2}
    assert url_filter.report(frame.limit(0)).count() == 0


def test_secrets_from_other_generators(spark):
    made = [system.token_hex(16).upper() for _ in range(60)] + [system.token_urlsafe(24) for _ in range(60)] + [base64.b64encode(os.urandom(24)).decode() for _ in range(60)] + [str(uuid.uuid4()).upper() for _ in range(60)]
    plain = ["-" * 20, "_" * 60, "=-" * 20, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "12345678901234567890", "Donaudampfschifffahrtsgesellschaft", "Rechtsschutzversicherungsgesellschaften", "internationalisation_of_responsibilities", "src/main/resources/templates/default", "test_that_the_parser_reads_all_of_the_input", "getElementsByClassNameFromDocument", "a" * 5000]
    docs = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(made + plain)], "doc_id bigint, text string").withColumn("secret_spans", F.lit(1))
    rows = {r["doc_id"]: r for r in secrets.with_spans(docs).collect()}
    hit = [any(s["kind"] == "random" for s in rows[i]["secret_spans"]) for i in range(len(made + plain))]
    assert sum(hit[: len(made)]) / len(made) > 0.97 and not any(hit[len(made) :]) and rows[0]["secret_spans_input"] == 1


def test_ibans_end_where_their_country_says(spark):
    texts = ["ES91 2100 0418 4502 0005 1332 BIC", "BE68 5390 0754 7034 THIS", "iban DE89370400440532013000.", "DE89370400440532013000X", "ZZ89370400440532013000", "GB82 WEST 1234 5698 7654 32 and DE89 3704 0044 0532 0130 00"]
    rows = pii.with_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [[s["text"] for s in r["pii_spans"] if s["kind"] == "iban"] for r in rows] == [["ES91 2100 0418 4502 0005 1332"], ["BE68 5390 0754 7034"], ["DE89370400440532013000"], [], [], ["GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00"]]


def test_context_on_both_sides_moves_scores(spark):
    texts = ["4111111111111111", "visa 4111111111111111", "4111111111111111 is the card", "order 4111111111111111", "555-123-4567 (phone)", "555-123-4567", "part 555-123-4567 tel"]
    rows = pii.with_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).withColumn("sure", F.size(pii.confident(F.col("pii_spans"), 0.9))).orderBy("doc_id").collect()
    scores = [[round(s["score"], 2) for s in r["pii_spans"]] for r in rows]
    assert scores == [[0.7], [1.0], [1.0], [0.4], [0.7], [], []] and [r["sure"] for r in rows] == [0, 1, 1, 0, 0, 0, 0]


def test_many_spans_in_one_text(spark):
    text = " ".join(f"a{i}@b.cd 1.2.3.{i % 256}" for i in range(6000))
    rows = pii.with_spans(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")).select("doc_id", "pii_spans", pii.redact(F.col("text"), F.col("pii_spans")).alias("r")).orderBy("doc_id").collect()
    assert len(rows[0]["pii_spans"]) == 12000 and all(text[s["start"] : s["end"]] == s["text"] for s in rows[0]["pii_spans"][::97])
    assert rows[0]["r"] == " ".join(["[EMAIL] [IP]"] * 6000) and rows[1]["r"] is None and rows[2]["r"] == ""


def unigram_model():
    """The given pieces as a unigram model: its kind rewritten, a score for each piece that adds up exactly in single precision."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def fields(data):
        at = 0
        while at < len(data):
            key, shift = 0, 0
            while True:
                b = data[at]
                at, key, shift = at + 1, key | (b & 127) << shift, shift + 7
                if b < 128:
                    break
            kind = key & 7
            if kind == 2:
                n = shift = 0
                while True:
                    b = data[at]
                    at, n, shift = at + 1, n | (b & 127) << shift, shift + 7
                    if b < 128:
                        break
                yield key, data[at : at + n]
                at += n
            elif kind == 0:
                begin = at
                while data[at] > 127:
                    at += 1
                at += 1
                yield key, data[begin:at]
            else:
                n = 4 if kind == 5 else 8
                yield key, data[at : at + n]
                at += n

    def put(key, value):
        return varint(key) + (varint(len(value)) if key & 7 == 2 else b"") + value

    rng, out = random.Random(4), b""
    whole = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL).serialized_model_proto()
    for key, value in fields(whole):
        if key >> 3 == 1:
            score = np.float32(-4 - rng.randrange(1 << 15) / 4096).tobytes()
            value = b"".join(put(k, score if k >> 3 == 2 else v) for k, v in fields(value))
        if key >> 3 == 2:
            value = b"".join(put(k, varint(1) if k >> 3 == 3 else v) for k, v in fields(value) if k >> 3 != 3) + put(3 << 3, varint(1))
        out += put(key, value)
    return out


def test_the_best_sums_are_those_of_the_library():
    model = unigram_model()
    library, pieces = sentencepiece.SentencePieceProcessor(model_proto=model), sentence_pieces.Pieces(model)
    assert not pieces.merges
    words = "the quick brown fox jumps over lazy dogs Entwicklung naïve 漢字 x1y2 ... == réponse año internationalization".split()
    rng, same, all_ = random.Random(5), 0, 0
    for _ in range(200):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))
        own, theirs = np.frombuffer(pieces.encode(text), "<i4").tolist(), library.encode(text)
        total = lambda ids: sum(library.get_score(i) for i in ids if not library.is_byte(i))
        assert total(own) >= total(theirs) - 1e-3 and pieces.decode(np.array(own, "<i4").tobytes()) == text
        same, all_ = same + (own == theirs), all_ + 1
    assert same / all_ > 0.95 and pieces.encoded("a  b")[1] == 0


def test_words_merged_step_by_step_are_counted(spark):
    rows = [(1, "plain words"), (2, "two  blanks"), (2, "two  blanks"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("token_ids", F.lit("x"))
    got = sentence_pieces.report(docs).collect()
    assert sorted((r["doc_id"], r["n_stepwise"] > 0) for r in got) == [(1, False), (2, True), (2, True), (3, False)]
    out = sentence_pieces.tokenized(docs)
    assert out.columns[2:] == ["token_ids_input", "token_ids", "n_tokens"]


def test_the_loss_mask_marks_what_is_said(spark):
    said = [("user", "<|im_end|> hi"), ("assistant", "<\\|x|> yes"), ("assistant", ""), ("user", None), ("assistant", "no <|")]
    turns = spark.createDataFrame([(7, 0, r, t) for r, t in said[:2]] + [(7, i, r, t) for i, (r, t) in enumerate(said) if i > 1] + [(8, 3, "assistant", "same"), (8, 3, "assistant", "same")], "conv_id bigint, turn bigint, role string, text string")
    rows = {r["conv_id"]: r for r in chat.format_conversations(turns).withColumn("said", chat.loss_text(chat.read_back(F.col("formatted")))).collect()}
    r = rows[7]
    parts = [r["formatted"][m["start"] : m["end"]] for m in r["loss_spans"]]
    assert parts == ["<\\\\|x|> yes", "", "no <\\|"] and "".join(p.replace("<\\\\|", "<\0|").replace("<\\|", "<|").replace("<\0|", "<\\|") for p in parts) == r["said"]
    assert len(rows[8]["loss_spans"]) == 2 and rows[8]["said"] == "samesame"


def test_a_cluster_needs_a_shared_folder():
    conf = lambda v: SimpleNamespace(get=lambda key, default=None: v)
    away = SimpleNamespace(conf=conf(None), sparkContext=SimpleNamespace(master="spark://x:7077", applicationId="app"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.folder(away)
    away.conf = conf("hdfs:///shared/")
    assert shared.folder(away) == "hdfs:///shared/spindle-app"


def test_batches_are_bounded_and_put_back(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    shared.restore_batches(spark)
    before = spark.conf.get(key)
    try:
        for text, want in (("64m", str(shared.BATCH_BYTES)), ("1k", "1k"), ("1000", "1000")):
            spark.conf.set(key, text)
            shared.bound_batches(spark)
            assert spark.conf.get(key) == want
            shared.restore_batches(spark)
            assert spark.conf.get(key) == text
    finally:
        spark.conf.set(key, before)
