"""The training-data operators against brute force, round trips and held-out accuracy, and on odd input."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kerbside import staging
from kerbside.llm import alignment, chat, html, linededup, mixing, packing, quality, registry, simhash, spelling, topk, toxicity, urls, warc
from kerbside.llm.components import component_labels
from kerbside.llm.words import n_words, words
from kerbside.staging import written
from tests.oracle import differences, views

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (None, "one two", None, "b", 7), (5, "one two", "de", "b", 7), (5, "one two", "de", "b", 7), (6, "é" * 40_000, "fr", None, 40_000), (7, "w " * 30_000, "fr", "a", 60_000)]


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, con, name):
    assert differences(registry.QUERIES[name](spark, SF), con, registry.SQL[name]) == ([], [])


def odd_docs(spark, rows=ODD):
    """Odd rows with extra columns whose names operators use themselves."""
    extra = ", size long, copies int, target double, fp long, component_id long, kept boolean, fill long, label string"
    return spark.createDataFrame([(*r, 9, 9, 9.0, 9, 9, False, 9, "x") for r in rows], DOCS + extra)


def test_words(spark):
    df = spark.createDataFrame([(None,), ("",), (" a\x0bb c\x1fd  ",)], "t string")
    assert [r[0] for r in df.select(words(F.col("t"))).collect()] == [[], [], ["a", "b c\x1fd"]]


# 1. Chat


def test_chat_round_trip(spark):
    texts = ["", "\\", "<|end|>\n", "a<|next|>b", "\\\\<|", "<", "|>", "x\ny", "é😀"]
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "a<|b", "\\"]), rng.choice([*texts, None])) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, None, "q"), (99, None, "user", "last"), (99, 1, "user", "x"), (99, 1, "user", "x")]
    read = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    for r in read.collect():
        mine = sorted((t is None, t or 0, role or "", (text or "").replace("\\", "\\\\").replace("<|", "<\\|"), text or "") for c, t, role, text in rows if c == r.conv_id)
        assert [(x.role, x.text) for x in r.turns] == [(m[2], m[4]) for m in mine]
        assert list(r.learned) == [m[4] for m in mine if m[2] == "assistant"]
        assert r.formatted.count("<|turn|>") == sum(1 for a, b in zip([None, *mine], mine) if a is None or a[2] != b[2])
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_long_texts_many_turns_and_clashing_names(spark):
    texts = ["é😀\\<|" * 50_000, "", "x" * (chat.PIECE - 20), "y" * chat.PIECE, "z" * (3 * chat.PIECE + 1)]
    rows = [(1, k, "user" if k % 3 else "assistant", t, "f", 5) for k, t in enumerate(texts)]
    rows += [(2, k, "assistant" if k // 7 % 2 else "user", f"t{k}", "f", 5) for k in range(5000)]
    read = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, loss_spans int")))
    for r in read.collect():
        mine = [(x[2], x[3]) for x in rows if x[0] == r.conv_id]
        assert [(x.role, x.text) for x in r.turns] == mine and list(r.learned) == [t for role, t in mine if role == "assistant"]


# 2. WARC


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "x" * 200
    rows = [(3, "http://a/1", long), (1, "http://a/2", long), (1, "http://a/2", long), (2, None, "short"), (4, "http://b c/", "short"), (5, "http://a", None), (None, "http://a", long), (6, "http://é", "é" * 100_000)]
    folder = f"file://{tmp_path}/w"
    done = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, archive_bytes=1000)
    assert written(done, "t").agg(F.sum("records")).first()[0] == len(rows)
    found = warc.read_archives(spark, folder).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in found) == Counter({(3, "revisit", 1): 1, (1, "response", None): 2, (2, "response", None): 1, (4, "response", None): 1, (5, "response", None): 1, (None, "revisit", 1): 1, (6, "response", None): 1})
    by_id = {r.page_id: r for r in found}
    assert by_id[3].payload_digest == hashlib.sha256(long.encode()).hexdigest() and by_id[3].payload_bytes == len(long)
    assert bytes(by_id[6].payload) == ("é" * 100_000).encode()


def test_warc_of_an_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    done = warc.write_archives(pages, f"file://{tmp_path}/none")
    assert written(done, "t").count() == 0 and warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0


def test_archives_hold_a_dictionary_and_survive_reruns():
    records = [warc.warc_record(i, f"http://example.org/{i}", f"<html><p>common words in every page {i}".encode() * 20, "d", 9, None) for i in range(300)]
    content = warc.compress_archive(records)
    assert content == warc.compress_archive(records) and int.from_bytes(content[:4], "little") == 0x184D2A5D and int.from_bytes(content[4:8], "little") > 0
    assert list(warc.read_archive(content)) == records
    assert list(warc.read_archive(warc.compress_archive([b"tiny"]))) == [b"tiny"]
    with pytest.raises(Exception, match="breaks off|Unknown|Src|rror"):
        list(warc.read_archive(content[:-10]))


# 3. Packing


def brute_tokens(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(registry.tokenizer_path())
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def test_word_by_word_ids_are_the_tokenizers():
    import pyarrow as pa

    texts = ["It's 5o'clock!! don't... A,b;c «x»", "É́é Σς İstanbul ｆｕｌｌ", "क़ क़ हिन्दी", "ड़, पेड़. \ufb1d!", "J̌ ǰ J̌, K", "a\x1fb c\xa0d", None, "", "x'S we'LL", "<|endoftext|> 中文, test…..", "a <|startoftext|>b<|endoftext|>", "9½²x _y_"]
    # Letters that normalisation composes, takes apart or lower-cases to two, marks, added tokens, white space.
    parts = list("aBjJtTwYéßİıΣſKµªº5²½क\u0958\u095c\ufb1d\u0344가\u1100\u1161") + ["\u0301", "\u030c", "\u0331", "\u0338", "\u0307", "\u093c", "\u05b4", "\u200d", ".", ",", "!", "*", "|", "<", ">", "'", "'s", "'LL", "’", "…", "-", "😀", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2000", "\u3000", "\u2028"]
    rng = random.Random(3)
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(30_000)]
    for at in range(0, len(texts), 5000):
        some = texts[at : at + 5000]
        ids, bounds = packing.token_ids(pa.array(some), registry.tokenizer_path())
        for text, want, a, b in zip(some, brute_tokens(some), bounds, bounds[1:]):
            assert ids[a:b].tolist() == want[:-1], text


def test_one_id_for_all_rows_is_many_partitions(spark):
    rows = written(spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), (F.col("id") % 900 + 1).alias("length")), "t")
    placed, info = packing.pack(rows, partition=300)
    assert placed.count() == 3000 and placed.select(F.shiftright("sequence_id", 24)).distinct().count() > 1 and info["sequences"] >= info["bound"]


def test_packing_whole_table(spark):
    docs = registry.table(spark, SF, "documents").unionByName(odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    pieces = written(packing.token_pieces(docs, registry.tokenizer_path()), "t")
    placed, info = packing.pack(pieces, partition=64)
    rows = placed.collect()
    want = Counter()
    for doc, ids in zip(docs.collect(), brute_tokens([d.text for d in docs.collect()])):
        for k in range(0, len(ids), 2048):
            want[(doc.doc_id, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert info["bound"] <= len(bins) == info["sequences"] <= info["bound"] + 1


def test_bounds_never_exceed_the_best_packing():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = rng.integers(1, 13, rng.integers(1, 8))
        best = len(lengths)
        def place(i, rooms):  # every packing of a handful of items
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(lengths):
                best = len(rooms)
                return
            for k, room in enumerate(rooms):
                if room >= lengths[i]:
                    place(i + 1, [*rooms[:k], room - lengths[i], *rooms[k + 1 :]])
            place(i + 1, [*rooms, 12 - lengths[i]])
        place(0, [])
        bound = packing.rounded(packing.fractional_bound(np.bincount(lengths, minlength=13), 12))
        _, _, fill = packing.best_fit_decreasing(lengths, 12)
        assert bound <= best <= len(fill)


def test_exchange_lowers_the_count(spark):
    rows = [(i, 0, int(x)) for i, x in enumerate(np.random.default_rng(2).integers(300, 900, 600))]
    pieces = written(spark.createDataFrame(rows, "doc_id long, piece int, length long"), "t")
    _, alone = packing.pack(pieces, partition=20, rounds=0)
    placed, together = packing.pack(pieces, partition=20, rounds=6)
    assert together["bound"] <= together["sequences"] < alone["sequences"] and placed.count() == 600
    assert packing.pack(pieces.limit(0))[0].count() == 0


# 4. URL filters


def test_url_lists_as_of(spark):
    entries = spark.createDataFrame(
        [("domain", "Example.org", "block", 10), ("domain", "example.org", "remove", 20), ("domain", "example.org", "remove", 20), ("host", "a.example.org", "allow", 5), ("prefix", "a.example.org/x/y", "block", 1), ("host", "b.org", "remove", 1), (None, "q", "block", 1), ("host", "c.org", "block", 3), ("host", "c.org", "allow", 3)],
        "scope string, pattern string, action string, listed_at int",
    )
    urls_ = [("http://x.example.org/", 10), ("http://x.example.org/", 9), ("http://x.example.org", 20), ("https://u@A.Example.org:80/x", 6), ("http://a.example.org/x/y/z?q", 6), ("http://a.example.org/x/yz", 6), ("http://notexample.org/", 15), ("mailto:me", 1), (None, 1), ("http://b.org/", None), ("http://C.org.", 4), ("http://b.org/" + "/" * 3000, 3)]
    captures = spark.createDataFrame([(u, t, "x") for u, t in urls_] * 2, "url string, fetched_at int, verdict string")
    found = urls.filter_urls(captures, entries).collect()
    assert len(found) == 2 * len(urls_)
    verdicts = {(r.url, r.fetched_at): r.verdict for r in found}
    assert [verdicts[k] for k in urls_] == ["block", "pass", "pass", "allow", "block", "allow", "pass", "invalid", "invalid", "pass", "block", "pass"]
    assert urls.filter_urls(captures, entries.limit(0)).where("verdict = 'pass'").count() == 20
    assert urls.filter_urls(captures.limit(0), entries).count() == 0


# 5. Mixing


def test_mixing_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "c", "d", None]) if i % 3 else "hot", rng.randint(0, 400)) for i in range(6000)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    assert len(found) == len(rows) and max(r.copies for r in found) <= 2
    total = sum(r[2] for r in rows)
    sums = {s: sum(r[2] for r in rows if r[1] == s) for s in {r[1] for r in rows}}
    targets = {r.source: r.target for r in found}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total
    order = sorted((s for s in sums if s is not None)) + [None]
    rate = {s: targets[s] / (5, 2, 1)[k % 3] for k, s in enumerate(order) if targets[s] < 2 * sums[s] - 1e-6}
    assert max(rate.values()) - min(rate.values()) < 1e-6 * max(rate.values())
    for s in sums:
        taken = sum(r.copies * r.size for r in found if r.source == s)
        assert abs(taken - targets[s]) < 0.02 * targets[s] + 800
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, source string, size long").repartition(7)).collect()
    assert {r.doc_id: r.copies for r in again} == {r.doc_id: r.copies for r in found}


def test_mixing_draws_the_same_texts_again(spark):
    rows = [(i % 40 if i % 3 else None, "s", 10 + i % 2, f"text {i}") for i in range(900)]
    draw = lambda df: Counter((r.text, r.copies) for r in mixing.mix(df).collect())
    shape = "doc_id long, source string, size long, text string"
    assert draw(spark.createDataFrame(rows, shape)) == draw(spark.createDataFrame(rows[::-1], shape).repartition(9))


def test_sources_that_begin_alike(spark):
    rows = [(f"http://host{i:04}.example/", 10) for i in range(500)] + [(None, 10)]
    found = {r["__source"]: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "__source string, source_size long").repartition(5)).collect()}
    order = sorted(x for x, _ in rows if x) + [None]
    heavy, light = {round(found[s], 6) for k, s in enumerate(order) if k % 3 == 0}, {round(found[s], 6) for k, s in enumerate(order) if k % 3 == 2}
    assert len(found) == 501 and heavy == {20.0} and len(light) == 1 and light < {19.9}.union(light) and sum(found.values()) == pytest.approx(1.5 * 5010)


def test_mixing_odd(spark):
    docs = odd_docs(spark).withColumn("size", n_words(F.col("text")))
    found = mixing.mix(docs)
    assert found.count() == len(ODD) and found.columns.count("copies") == 1
    assert mixing.mix(docs.limit(0)).count() == 0


# 6. Quality


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10), (3, 100), (20, 1000), (1, 500), (40, 100), (0, 1), (150, 20_000)]
    found = spark.createDataFrame(cases, "x long, n long").select(quality.binomial_tail(F.col("x"), F.col("n"), 0.02)).collect()
    for (x, n), row in zip(cases, found):
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(0.02) + (n - k) * math.log(0.98)) for k in range(x + 1))
        assert row[0] == pytest.approx(1.0 if x > n * 0.02 else exact, rel=1e-9)


def test_cutoffs_reject_bad_and_spare_good(spark):
    rng = random.Random(6)
    good = lambda: " ".join(f"word{rng.randint(0, 10**6)}" for _ in range(80))
    rows = [(i, " ".join(f"{w}***" for w in good().split()) if i % 5 == 0 else good(), "en", "s", 0) for i in range(4000)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 4000)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i in range(4000) if i % 5}
    few = quality.assess(docs, labels.limit(50))
    assert few.where("kept").count() == 4000  # too few labels to show anything: no rule


def test_cutoffs_of_few_labels(spark):
    rows = [(10 * k + i, " ".join(f"{'w***' if i == 9 else 'w'}{k}x{j}" for j in range(60)), lang, "s", 0) for lang, at in (("de", 0), ("fr", 1000)) for k in range(at, at + 40) for i in range(10)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(r[0], int(r[0] % 10 != 9)) for r in rows], "doc_id long, quality int")
    assert sorted(r.doc_id for r in quality.keep_good(docs, labels).collect()) == sorted(r[0] for r in rows if r[0] % 10 != 9)  # 360 good ones a language are enough
    fitted = quality.fit_cutoffs(quality.with_signals(docs, F.col("doc_id"), quality.stratum(F.col("lang")).alias("__stratum")), labels).collect()
    assert len(fitted) == 2 and all(r[name] == grid[0] for r in fitted for name, grid in quality.GRIDS.items())


def brute_signals(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    times = Counter(windows)
    repeated = {p for i, w in enumerate(windows) if times[w] > 1 for p in (i, i + 1, i + 2)}
    n, chars = len(found), sum(map(len, found))
    per = lambda a, b: a / b if b else 0.0
    values = {"symbol_rate": per(len(re.findall(r"[#*$%&|<>]", text or "")), n), "dup_line_share": per(len(lines) - len(set(lines)), len(lines)), "repeat_share": per(len(repeated), n), "capital_share": per(sum(c.isupper() for c in text or ""), chars), "bar_rate": per(found.count("|"), n)}
    return values, n < 50 or 100 * len(repeated) > 50 * n


def brute_verdicts(docs, labels, alpha=0.02, delta=0.05):
    """Verdicts by the rule as it is stated: steps from the mildest on, an exact test at each, stop at the first that fails."""
    judged = {i: (lang, *brute_signals(text)) for i, text, lang in docs}
    reached = lambda values, step: any(values[name] >= grid[step] for name, grid in quality.GRIDS.items())
    good = {}
    for i, q in labels:
        if q == 1 and i in judged and not judged[i][2]:
            good.setdefault(judged[i][0], []).append(judged[i][1])
    chosen = {}
    for lang, values in good.items():
        for step in reversed(range(20)):
            x, n = sum(reached(v, step) for v in values), len(values)
            tail = sum(math.comb(n, k) * alpha**k * (1 - alpha) ** (n - k) for k in range(x + 1))
            if tail > delta / len(good):
                break
            chosen[lang] = step
    return {i: not failed and not (lang in chosen and reached(values, chosen[lang])) for i, (lang, values, failed) in judged.items()}, chosen


def test_verdicts_of_planted_labels(spark):
    rng = random.Random(12)
    word = lambda: f"w{rng.randint(0, 10**7)}"

    def text(kind):
        some = [word() for _ in range(rng.randint(45, 90))]
        if kind == 1:
            return " ".join(w + "#" * (rng.random() < rng.random()) for w in some)
        if kind == 2:
            return "\n".join([" ".join(some), *["the same line here"] * rng.randint(1, 4)])
        if kind == 3:
            return " ".join(w.upper() if rng.random() < rng.random() else w for w in some)
        if kind == 4:
            return " ".join(some + ["|"] * rng.randint(1, 40))
        return " ".join(some + some[: rng.randint(0, 9)])

    share = {"de": 0.002, "fr": 0.02, "es": 0.0, None: 0.1, "few": 0.0}
    docs = [(i, text(rng.randint(1, 4) if bad else 0), lang, bad) for i, (lang, bad) in enumerate((lang, k % 10 == 9 or rng.random() < rate) for lang, rate in share.items() for k in range(400 if lang != "few" else 60))]
    labels = [(i, int(i % 10 != 9) if i % 50 else None) for i, *_ in docs] + [(3, 0), (10**6, 1)]
    want, chosen = brute_verdicts([d[:3] for d in docs], labels)
    assert len(set(chosen.values())) > 1 and "few" not in chosen and 0 < sum(want.values()) < len(docs)
    frame = spark.createDataFrame([d[:3] for d in docs], "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    assert {r.doc_id: r.kept for r in quality.assess(frame, known).collect()} == want
    assert sorted(r.doc_id for r in quality.keep_good(frame, known).collect()) == [i for i, kept in want.items() if kept]


def test_quality_odd(spark):
    labels = spark.createDataFrame([(1, None), (2, 0), (5, 1)], "doc_id long, quality int")
    found = quality.assess(odd_docs(spark), labels)
    assert found.count() == len(ODD) and found.where("kept").count() == 0
    assert {r.n_repeat_words for r in found.where("doc_id = 7").collect()} == {30_000}
    assert quality.assess(odd_docs(spark).limit(0), labels).count() == 0
    assert quality.keep_good(odd_docs(spark), labels).columns == odd_docs(spark).columns


# 7. Top-k


def test_top_k_brute_force(spark):
    rng = random.Random(8)
    vectors = {i: [rng.randint(-3, 3) for _ in range(rng.choice([4, 5]))] for i in range(400)} | {1000: [], 1100: [0, 0]}
    # An id that another row repeats, with its vector or with another, also among the queries.
    rows = [*vectors.items(), (7, vectors[7]), (7, [3, 3, 3, 3]), (100, vectors[100]), (200, [1, 2, 3, 1])]
    df = spark.createDataFrame([(*r, "x", 0) for r in [*rows, (None, [1]), (2001, None)]], "vec_id long, components array<long>, row string, rank long")
    found = topk.top_k(df, F.col("vec_id") % 100 == 0).collect()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = Counter()
    for at, (q, vector) in enumerate(rows):
        if q % 100 == 0:
            best = sorted((-dot(vector, v), i) for k, (i, v) in enumerate(rows) if k != at)[:10]
            want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == want
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_components(spark):
    df = spark.createDataFrame([([1.5, -0.3],), ([float("nan")],), ([float("inf")],), ([None],), (None,), ([],)], "v array<float>")
    assert [r[0] for r in df.select(topk.integer_components(F.col("v"))).collect()] == [[1536, math.floor(1024 * float(np.float32(-0.3)))], None, None, None, None, []]


# 8. HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("just text &lt;b&gt; &amp; &eacute;&nbsp;x", "just text <b> & é x"), ("<p>a<p>b<br>c", "a b c"), ("<script>x<y</script><style>p</style><!-- c", ""), ("<div>" * 3000 + "deep", "deep"),
        ("<body><nav>menu</nav><article><h1>T</h1><p>Some longer text, with commas, in it.<div class='ad-box'>Buy, now, cheap, things here today</div><p>More <b>bold</b>text.<footer>by me</footer></article><aside>side</aside><footer>f</footer>", "T Some longer text, with commas, in it. More boldtext."),
        ("<div id=page><div class=sidebar><p>Long, long, sidebar text, with many, many commas, here</div><div id=main-text><p>The first paragraph, which is the longer one of them.<p>The second one, as well.</div><form><p>Sign up, please, for our letter today</form><div id='comments'><p>Reader, comment, with, commas, that is quite long</div></div>", "The first paragraph, which is the longer one of them. The second one, as well."),
        ("<main><table><tr><td>cell one<td>cell two</table><ul><li>x<li>y</ul></main>", "cell one cell two x y"), ('<p title="a>b">quoted, attribute, in a tag that goes on</p><p hidden>not shown, yet text</p>', "quoted, attribute, in a tag that goes on not shown, yet text"),
        ("<nav>menu</nav><article><p>Intro text, that is long enough, to count.</p><div class='share-price-table'><p>Share price is twelve, today, at noon</p></div><div class='search-results-study'><p>The study, found, that results matter</p></div><div class='ad-box'>Buy now</div><div class='reader-comments'>c</div><div id=newsletter-signup>s</div><ul><li><a href=a>one</a><li><a href=b>two</a><li><a href=c>three</a></ul></article><div class='more-related-stories'><p>Other, stories, that we have written here before</p></div>", "Intro text, that is long enough, to count. Share price is twelve, today, at noon The study, found, that results matter one two three"),
        ("<div class='promoted-research'><p>Without an article, marked as one, a word of a name is not enough.</p></div>", "Without an article, marked as one, a word of a name is not enough."), ("<script>İİİİ</SCRIPT>after the script", "after the script"), ("text &am", "text &am"), ("<p>cut off in a tag <a hre", "cut off in a tag"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def brute_tree(page):
    """Parents and tags as ``parse`` should find them, by walking the open elements each time."""
    nodes, path = [("#", 0)], [0]
    for end, tag in re.findall(r"<(/?)([a-z0-9]+)>", page):
        if end:
            for depth in range(len(path) - 1, 0, -1):
                if nodes[path[depth]][0] == tag:
                    del path[depth:]
                    break
            continue
        for closes, (tags, bounds) in (("p" if tag in html.CLOSES_P else None, ({"p"}, {"td", "th", "table", "button"})), (tag, html.IMPLIED.get(tag, ((), ())))):
            for depth in range(len(path) - 1, 0, -1):
                name = nodes[path[depth]][0]
                if closes is None or name in bounds:
                    break
                if name in tags:
                    while nodes[path[depth - 1]][0] in tags:
                        depth -= 1
                    del path[depth:]
                    break
        if tag not in html.VOID:
            nodes.append((tag, path[-1]))
            path.append(len(nodes) - 1)
    return nodes


def test_tree_of_tag_soup():
    rng = random.Random(2)
    tags = "p div ul li table tr td th b a dl dt dd br span section option select button".split()
    for _ in range(400):
        page = "".join(f"<{'/' * (rng.random() < 0.4)}{rng.choice(tags)}>x" for _ in range(rng.randint(1, 60)))
        found = html.parse(page)
        assert list(zip(found.tag, found.parent)) == brute_tree(page), page


def test_broken_pages_take_linear_time():
    for part in ("<div><p>x", "x</b></i>", "<td><div>", "<p><b>y", "<li><ul>", "<!-- <p '"):
        start = time.perf_counter()
        html.main_text("<p><table><tr><td>" + part * 40_000)
        assert time.perf_counter() - start < 6, part


def test_html_table(spark):
    pages = spark.createDataFrame([(1, None, "<p>a"), (None, "u", None), (1, None, "<p>a")], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html.extract_main_text(pages).collect()) == [(0, "", 0), (1, "a", 1), (1, "a", 1)]


def test_main_text_with_clashing_columns_nulls_and_no_rows(spark):
    schema = "text string, page_id long, n_chars int, __html string, html string, url string"
    page = "<body><nav>menu</nav><article><p>A story, told.</p></article></body>"
    pages = spark.createDataFrame([("x", 1, 7, "y", page, None), ("x", None, 7, "y", None, "u"), ("x", 2, 7, "y", "", "u"), ("x", 1, 7, "y", page, None)], schema)
    found = html.extract_main_text(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(found.collect(), key=lambda r: r.page_id or 0) == [(None, "u", "", 0), (1, None, "A story, told.", 14), (1, None, "A story, told.", 14), (2, "u", "", 0)]
    assert html.extract_main_text(pages.limit(0)).count() == 0


# 9. SimHash


def reference_fingerprint(text):
    import re

    import xxhash

    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(found[i : i + 4]) for i in range(len(found) - 3)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    parent = {k: k for k in {f for _, f in pairs}}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(parent)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[find(b)] = find(a)
    least = {}
    for doc, f in pairs:
        least[find(f)] = min(least.get(find(f), doc), doc)
    return {doc: least[find(f)] for doc, f in pairs}


def test_simhash_whole_table(spark):
    docs = registry.table(spark, SF, "documents").unionByName(odd_docs(spark).where("doc_id is not null").select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", F.col("doc_id") + 10_000))
    found = simhash.near_duplicate_components(docs).collect()
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    pairs = [(i, reference_fingerprint(t)) for i, t in texts]
    assert {(r.doc_id, r.fp & (2**64 - 1)) for r in found} == set(pairs)
    want = brute_components(pairs)
    assert all(want[r.doc_id] == r.component_id for r in found) and len(found) == docs.count()


@pytest.mark.parametrize("block", [4, 4096])
def test_ball_hashing_finds_every_link(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "RANGE", 5000)
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, 1, 2**64 - 1]
    fps = set(base)
    for f in base:
        for bits in (1, 2, 3, 4, 5, 6):
            flip = f
            for b in rng.sample(range(64), bits):
                flip ^= 1 << b
            fps.add(flip)
    edges = simhash.linked_fingerprints(written(spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long"), "t"))
    found = {r.node & (2**64 - 1): r.label & (2**64 - 1) for r in component_labels(edges).collect()}
    order = sorted(fps)
    want = brute_components([(k, f) for k, f in enumerate(order)])
    groups = {}
    for k, f in enumerate(order):
        groups.setdefault(want[k], set()).add(f)
    got = {}
    for f in order:
        got.setdefault(found.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


@pytest.mark.parametrize("n,links", [(0, 0), (1, 0), (60, 25), (60, 200), (500, 490)])
def test_least_member_of_a_block(n, links):
    rng = random.Random(n + links)
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(links)} | ({(k, k + 1) for k in range(n - 60, n - 1)} if n > 100 else set())
    want = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    codes = np.array([a * n + b for a, b in sorted(pairs, key=lambda p: rng.random())], dtype=np.int64)
    assert simhash._least_member(n, codes).tolist() == want


def test_workers_get_whole_texts_in_small_batches(spark, monkeypatch):
    name, seen, real = "spark.sql.execution.arrow.maxBytesPerBatch", {}, staging.written
    texts = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("0123456789"), 400).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])

    made = staging.written_from_texts(texts.mapInArrow(sizes, "rows long, bytes long"), "t").collect()
    assert sum(r.rows for r in made) == 4000 and max(r.bytes for r in made) < staging.TEXT_BATCH + 5000 and spark.conf.get(name, None) is None
    monkeypatch.setattr(staging, "written", lambda df, label: seen.update({label: spark.conf.get(name)}) or real(df, label))
    docs = odd_docs(spark)
    packing.pack_documents(docs, registry.tokenizer_path())
    simhash.keep_one_of_each(docs)
    corpus_pipeline.toxicity_grades(spark, docs, SF)
    assert seen == dict.fromkeys(["packing-pieces", "simhash-fps", "pipeline-civil"], str(staging.TEXT_BATCH))
    spark.conf.set(name, "1m")  # a session's own size stays
    try:
        staging.written_from_texts(docs, "own")
        assert seen["own"] == spark.conf.get(name) == "1m"
    finally:
        spark.conf.unset(name)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 800), (800, 900), (5, 5)], "src long, dst long")
    found = {r.node: r.label for r in component_labels(edges).collect()}
    assert found == {i: 0 for i in range(301)} | {800: 800, 900: 800}


def test_keep_one(spark):
    kept = simhash.keep_one_of_each(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5, 6, 7]
    assert simhash.keep_one_of_each(odd_docs(spark).limit(0)).count() == 0


def test_keep_one_without_an_id_of_its_own(spark):
    text = lambda seed: " ".join(f"{seed}{k * k}" for k in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (4, text("c")), (4, text("d")), (4, text("d")), (9, text("e")), (None, text("e")), (3, text("f")), (4, text("f"))]
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, text("a")), (None, text("b")), (4, text("c")), (4, text("d")), (9, text("e")), (3, text("f"))]
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(want)


# 10. Toxicity


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "ke", "li", "mo", "nu", "re", "so"]) for _ in range(rng.randint(2, 5)))
    rows = []
    for i in range(n):
        tokens = [word() for _ in range(rng.randint(20, 120))]
        if i % 4 == 0:
            for _ in range(rng.randint(2, 9)):
                tokens.insert(rng.randrange(len(tokens)), rng.choice(["idiot", "Scum!!", "xyzzy" + word(), "PATHETIC,"]))
        rows.append((i, " ".join(tokens)))
    return rows


def test_toxicity_held_out(spark):
    docs = spark.createDataFrame(toxic_corpus(2400, 1), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1600)] + [(1600, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, sample=1600)
    assert model.thresholds == sorted(model.thresholds)
    rows = [r for r in toxicity.score(docs, model).collect() if r.doc_id > 1600]
    hit = sum(r.toxic for r in rows if r.doc_id % 4 == 0) / sum(r.doc_id % 4 == 0 for r in rows)
    wrong = sum(r.toxic for r in rows if r.doc_id % 4)
    assert hit > 0.97 and wrong <= 3
    assert len({r.grade for r in rows}) >= 3
    again = toxicity.fit(docs.repartition(5), labels, sample=1600)
    assert again.cutoff == model.cutoff and again.thresholds == model.thresholds


def test_scores_by_hand(spark):
    rows = [(i, t) for i, t in enumerate(["you idiot, you IDIOT", "idiots!! scum", "nothing here", None, "", " \t", "scum " * 50_000, "idiotic\x1fscummy"])]
    model = toxicity.Ordinal({"w:idiot": 1.5, "s:idio": 0.5, "s:idiot": 0.25, "w:scum": 2.0, "s:scum": -0.5}, [1.0, 2.0, 4.0], cutoff=1.2)

    def severity(text):
        total = 0.0
        for word in set((text or "").lower().split()):
            bare = word.strip("!,.")
            total += model.weights.get(f"w:{bare}", 0) + sum(model.weights.get(f"s:{bare[:n]}", 0) for n in (4, 5, 6) if len(bare) > n)
        return sum(1 / (1 + math.exp(cut - total)) for cut in model.thresholds)

    want = {i: severity(t) for i, t in rows}
    found = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.severity for r in found} == pytest.approx(want)
    assert all(r.grade == round(want[r.doc_id]) and r.toxic == (want[r.doc_id] >= 1.2) for r in found)
    kept = toxicity.keep_civil(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert sorted(r.doc_id for r in kept) == [i for i in want if want[i] < 1.2]


def test_labels_that_disagree_and_ids_of_many_rows(spark):
    docs = spark.createDataFrame(toxic_corpus(800, 4), "doc_id long, text string")
    labels = [(i, int(i % 4 == 0)) for i in range(800)]
    fit = lambda extra, more: toxicity.fit(docs.unionByName(spark.createDataFrame(more, "doc_id long, text string")), spark.createDataFrame(labels + extra, "doc_id long, toxic int"))
    plain = fit([], [(10**6, "x")])
    assert plain.weights and fit([(i, 0) for i in range(0, 800, 4)] + [(5, None), (None, 1)], [(i, "~ later text") for i in range(800)] * 3) == plain
    texts = [{"a", "b", "c", f"x{k}"} for k in range(3)] + [{"a", "b", "c", "d", "e", "f"}]
    assert toxicity._without_copies([*texts, texts[0], texts[0]], np.array([0, 0, 0, 0, 0, 1])) == [0, 1, 2, 3, 5]


def test_toxicity_odd(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(odd_docs(spark), labels)
    assert toxicity.score(odd_docs(spark), model).where("not toxic").count() == len(ODD)
    assert toxicity.keep_civil(odd_docs(spark), model).count() == len(ODD)


# Pipeline


def pipeline_stages(spark, docs, sf):
    import corpus_pipeline as P

    stages = {}
    for name, stage in P.STAGES:
        before, docs = docs, written(stage(spark, docs, sf), "t")
        stages[name] = (before, docs)
        if name != P.STAGES[-1][0]:
            assert docs.columns == before.columns
    return stages


def check_stages(spark, stages, labels):
    """Each stage's rows against brute force on what it was given."""
    row = lambda r: (r.doc_id, r.text, r.lang, r.source)
    before, after = stages["quality rules"]
    numbered = dict(enumerate(before.collect()))
    ids = {}
    for k, r in numbered.items():
        ids.setdefault(r.doc_id, []).append(k)
    want, _ = brute_verdicts([(k, r.text, r.lang) for k, r in numbered.items()], [(k, q) for i, q, _ in labels for k in ids.get(i, []) if i is not None])
    assert Counter(map(row, after.collect())) == Counter(row(r) for k, r in numbered.items() if want[k])
    before, after = stages["toxicity"]
    model = toxicity.fit(before, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    civil = [r for r in before.collect() if model.expected([sum(model.weights.get(f, 0.0) for w in set((r.text or "").lower().split()) for f in toxicity.features(w))])[0] < model.cutoff]
    assert Counter(map(row, after.collect())) == Counter(map(row, civil))
    before, after = stages["SimHash near-dedup"]
    rows = sorted({(r.doc_id is None, r.doc_id or 0, r.text) for r in before.collect()}, key=str)
    component = brute_components([(k, reference_fingerprint(r[2])) for k, r in enumerate(rows)])
    kept = [(r.doc_id is None, r.doc_id or 0, r.text) for r in after.collect()]
    assert len(set(kept)) == len(kept) and sorted(component[rows.index(r)] for r in kept) == sorted(set(component.values()))
    assert all(r[:2] == min(x[:2] for k, x in enumerate(rows) if component[k] == component[rows.index(r)]) for r in kept)
    before, after = stages["mixing sources to target weights"]
    mixed = mixing.mix(before.withColumn("size", n_words(F.col("text")))).collect()
    assert sum((Counter({row(r): r.copies}) for r in mixed), Counter()) == Counter(map(row, after.collect()))
    before, after = stages["best-fit packing"]
    want = Counter()
    for r, ids in zip(before.collect(), brute_tokens([r.text for r in before.collect()])):
        want.update((r.doc_id, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048))
    placed = after.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed) == want
    fill = Counter()
    for r in sorted(placed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert not fill or max(fill.values()) <= 2048


def test_pipeline_against_brute_force(spark):
    labels = [tuple(r) for r in registry.table(spark, SF, "labels").select("doc_id", "quality", "toxic").collect()]
    check_stages(spark, pipeline_stages(spark, registry.table(spark, SF, "documents"), SF), labels)


def test_pipeline_of_odd_and_of_no_documents(spark, tmp_path):
    rng = random.Random(1)
    text = lambda k: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(k))
    same = text(90)
    rows = [(None, text(80), "en", "a", 1), (None, text(80), None, None, 1), (None, text(80), "en", "a", None), (1, same, "en", "a", 9), (None, same, "en", "b", 9), (1, same, "en", "a", 9), (2, text(70), "en", "a", 0), (2, text(70), "en", "a", 0), (3, text(6000), "de", "c", 0), (4, None, "de", "c", 0), (5, "", "de", "c", 0), (6, " ".join(["x"] * 300), "de", "c", 0), (7, text(60).replace("w", "İ\u0958,"), "hi", "c", 0)]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (3, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    frame = spark.createDataFrame(rows, DOCS)
    stages = pipeline_stages(spark, frame, f"file://{tmp_path}")
    check_stages(spark, stages, labels)
    assert stages["SimHash near-dedup"][1].where("doc_id is null").count() == 3 and stages["SimHash near-dedup"][1].where("doc_id = 2").count() == 2
    assert all(after.count() == 0 for _, after in pipeline_stages(spark, frame.limit(0), f"file://{tmp_path}").values())


# 11. Alignment of two tokenizers


A, B = (registry.tokenizer_path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def aligned_by_hand(rows):
    """Whole texts tokenised at once, overlaps by comparing every pair of a group, counts by a dictionary."""
    pair, docs = alignment.Pair(A, B), []
    for doc, text in rows:
        a, b = ([], []) if not text else (pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text))
        spelled = (" " + text).encode() if text else b""
        if not text or b"".join(pair.a_bytes[i] for i in a) != spelled or b"".join(pair.b_bytes[i] for i in b) != spelled:
            docs.append((doc, 0, 0, 0, [], ""))
            continue
        ends = lambda ids, table: list(np.cumsum([len(table[i]) for i in ids]))
        a_ends, b_ends = ends(a, pair.a_bytes), ends(b, pair.b_bytes)
        links, groups, low = [], [], 0
        for cut in sorted(set(a_ends) & set(b_ends)):
            mine, other = ([k for k, e in enumerate(x) if low < e <= cut] for x in (a_ends, b_ends))
            groups.append(",".join(str(a[k]) for k in mine) + "|" + ",".join(str(b[k]) for k in other))
            links += [(a[i], b[j]) for i in mine for j in other if max(a_ends[i] - len(pair.a_bytes[a[i]]), b_ends[j] - len(pair.b_bytes[b[j]])) < min(a_ends[i], b_ends[j])]
            low = cut
        docs.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    n = Counter(link for d in docs for link in set(d[4]))
    top = Counter()
    for (a, _), times in n.items():
        top[a] = max(top[a], times)
    return Counter((*d[:4], len(d[4]), sum(n[x] == top[x[0]] for x in d[4]), sum(n[x] for x in d[4]), d[5]) for d in docs)


PIECES = ["a", "the", "ing", " ", "  ", "\n", "\t", "é", "ß", "\u00a0", "\u2003", "x\u0301", "<|endoftext|>", "<s>", "'s", "'ll", "12", "!?", "▁", "\x00", "😀", "中文", "\x85", "\x0b", "\x1c", " \n", "\r\n", ".", "("]


@pytest.mark.parametrize("chunk", [40, 1 << 15])
def test_alignment_is_that_of_whole_texts(spark, chunk):
    rng = random.Random(chunk)
    rows = [(k, "".join(rng.choices(PIECES, k=rng.randrange(1, 40)))) for k in range(600)]
    rows += [(None, None), (7, ""), (7, " "), (7, " "), (8, "\n"), (9, "x" * 3000), (10, "word " * 1500), (11, "".join(rng.choices([p for p in PIECES if p != "▁"], k=3000)))]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_a long, sha string")
    found = alignment.align_tokenizers(docs, A, B, chunk=chunk)
    assert Counter(tuple(r) for r in found.collect()) == aligned_by_hand(rows)


def test_alignment_of_real_documents(spark):
    rows = [tuple(r) for r in registry.table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in registry.op11_tokenizer_alignment(spark, SF).collect()) == aligned_by_hand(rows)


def test_fragments_compose_in_any_order():
    pair, rng = alignment.pair_of((A, B)), random.Random(2)
    text = "".join(rng.choices([p for p in PIECES if p != "▁"], k=300))
    ids = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    tokens = alignment.Tokens(*(np.array(x, np.int64) for x in (ids[0], np.cumsum(pair.a_size[ids[0]]), ids[1], np.cumsum(pair.b_size[ids[1]]))))
    parts = [alignment.fragment(tokens.upto(low, low + 7), pair) for low in range(0, int(tokens.a_ends[-1]), 7)]
    while len(parts) > 1:
        k = rng.randrange(len(parts) - 1)
        parts[k : k + 2] = [alignment.compose(parts[k], parts[k + 1], pair)]
    whole = alignment.fragment(tokens, pair)
    empty = alignment.Fragment()
    for found in (parts[0], alignment.compose(empty, whole, pair), alignment.compose(whole, empty, pair)):
        assert (found.text, found.n_groups, found.links.tolist()) == (whole.text, whole.n_groups, whole.links.tolist())
        assert all(x.tolist() == y.tolist() for x, y in zip((*found.first, *found.last), (*whole.first, *whole.last)))


def test_alignment_of_nothing(spark):
    assert alignment.align_tokenizers(spark.createDataFrame([], DOCS), A, B).collect() == []
    found = {(r.doc_id, r.n_a > 0, r.groups_sha256 == "") for r in alignment.align_tokenizers(odd_docs(spark), A, B).collect()}
    assert found == {(1, False, True), (2, False, True), (3, True, False), (None, True, False), (5, True, False), (6, True, False), (7, True, False)}


# 12. Spelling variants


def variants_by_hand(n, times=10):
    near, without = {w: set() for w in n}, {}
    for w in n:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            without.setdefault((i, rest), []).append(w)
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    for some in without.values():
        for w in some:
            near[w].update(x for x in some if x != w)
    best = {w: min(x, key=lambda y: (-n[y], y)) for w, x in near.items() if x}
    form = {w: x for w, x in best.items() if n[x] >= times * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return Counter((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


@pytest.mark.parametrize("alphabet,size,most", [("abé", 900, 25), ("ab", 700, 8), ("abcdefgh", 1500, 20_000)])
def test_variants_by_composition(spark, alphabet, size, most):
    """Small ``most``: prefixes and suffixes are so common that edits fall between them."""
    rng = random.Random(size)
    n = {"".join(rng.choices(alphabet, k=rng.randrange(1, 12))): rng.choice([2, 3, 30, 400, 5000]) for _ in range(size)}
    n |= {"abcdefgh" * 2 + "".join(rng.choices("ab", k=rng.randrange(1, 7))): 5 for _ in range(100)} | {"é" * 5000: 2, "é" * 4999: 40}
    words = spark.createDataFrame([*n.items(), (None, 3), ("", 5)], "word string, n long")
    found = spelling.variant_groups(words, 10, most).select("word", "form", "root", "n", "n_near", "form_n")
    assert Counter(tuple(r) for r in found.collect()) == variants_by_hand(n)


def test_spelling_variants_of_documents(spark):
    n = Counter()
    for doc, text in registry.table(spark, SF, "documents").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    found = registry.op12_spelling_variants(spark, SF)
    assert Counter(tuple(r) for r in found.collect()) == variants_by_hand(n)
    assert len(n) > 1000


def test_spelling_of_odd_documents(spark):
    words = spelling.spelled(odd_docs(spark), 3)
    assert {(r.word[:3], len(r.word), r.n) for r in words.collect()} == {("one", 3, 3), ("two", 3, 3), ("ééé", 40_000, 1)}
    assert spelling.variant_groups(words).count() == 3
    none = spelling.spelled(spark.createDataFrame([], DOCS), 3)
    assert (none.count(), spelling.variant_groups(none).count()) == (0, 0)


# 13. Lines


def lines_by_hand(rows, least_chars=20, least_docs=3):
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(doc)
    order = lambda doc: (doc is not None, doc or 0)
    keeper = {k: max(docs, key=order) for k, docs in holders.items() if len(docs) >= least_docs}
    out = Counter()
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == doc]
        out[doc, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("batches,fan_out", [(1, 2), (7, 2), (12, 3)])
def test_lines_dropped_as_by_hand(spark, batches, fan_out):
    rng = random.Random(batches)
    lines = ["", " ", "short", "A line of some length é", "a LINE of some length é\t", "another line that is long", "\x0bAnother line that is long ", "É line of some length here", "é line of some length here", "x" * 19, "y" * 20]
    lines += [f"line number {k} that few hold" for k in range(30)]
    rows = [(k, "\n".join(rng.choices(lines, k=rng.randrange(0, 9)))) for k in range(150)]
    rows += [(None, "\n".join(lines)), (None, "a line of some length é"), (3, "\n".join(lines)), (3, rows[3][1]), (3, rows[3][1]), (400, None), (401, ""), (402, "\n" * 3), (-5, "\n".join(lines * 3))]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, pos int, h1 long, lost string").repartition(3)
    assert Counter(tuple(r) for r in linededup.dedup_lines(docs, batches=batches, fan_out=fan_out).collect()) == lines_by_hand(rows)


def test_line_runs_are_compacted(spark):
    runs = linededup.LineRuns(spark, 2)
    for k in range(5):
        made = runs.sorted_run(spark.createDataFrame([(k, 0, 1), (99, 0, 1)], "h1 long, h2 long, n long"))
        assert [r.h1 for r in runs.unseen(made).collect()] == ([0, 99] if not k else [k])
        runs.add(made)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {(r.h1, r.n) for r in runs.totals().collect()} == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (99, 5)}
    plan = runs.unseen(made)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.forget()


def test_lines_of_odd_and_no_documents(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], DOCS)).collect() == []
    assert {(r.doc_id, r.n_lines, r.n_dropped) for r in linededup.dedup_lines(odd_docs(spark)).collect()} == {(1, 1, 0), (2, 1, 0), (3, 2, 0), (None, 1, 0), (5, 1, 0), (6, 1, 0), (7, 1, 0)}


# Mended


def test_scores_that_do_not_fit_are_refused(spark):
    rows = spark.createDataFrame([(0, [2**31, 2**31]), (100, [1, 1])], "vec_id long, components array<long>")
    with pytest.raises(OverflowError, match="64 bits"):
        topk.top_k(rows, F.col("vec_id") % 100 == 0)


def test_long_conversation_in_time(spark):
    n = 20_000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "assistant").otherwise("user").alias("role"), F.concat(F.lit("hi <| wörld "), "id").alias("text"))
    chat.format_conversations(turns.limit(10)).collect()
    began = time.time()
    found = chat.read_back(chat.format_conversations(turns)).select(F.size("turns").alias("n"), F.sha2(F.array_join("learned", "").cast("binary"), 256).alias("sha")).first()
    assert found.n == n and found.sha == hashlib.sha256("".join(f"hi <| wörld {k}" for k in range(0, n, 3)).encode()).hexdigest()
    assert time.time() - began < 15


STORY = "This is a long paragraph, with commas, and many words that go on and on, to be the main story of the page. " * 3


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<h1>T</h1><div class=post><p>{STORY}<p>{STORY}</div><ul><li>fact one<li>fact two</ul><table><tr><td>a<td>b</table><blockquote>q</blockquote><section><h2>s</h2><p>short</section>", f"T {STORY}{STORY}fact one fact two a b q s short"),
        (f"<article><p>{STORY}<div class=usercomments><p>{STORY}</div><div id=cookiebanner>c</div></article><div class=cookiebanner><p>{STORY * 4}</div>", STORY),
        (f"<article><p>{STORY}</article><div class=xnotice><p>{STORY * 3}</div>", STORY),
        (f"<article><p>{STORY}</article><article><p>a short one</article>", f"{STORY}a short one"),
        (f"<div>My Site</div><nav>m</nav><p>lead</p><div><p>{STORY}</div><div><a>one</a> <a>two</a> <a>three</a></div>", f"lead {STORY}"),
        (f"<main><h1>t</h1><article><p>{STORY}</article><p>after</main>", f"t {STORY}after"),
        (f"<div class=headline>h</div><div class=spread><p>{STORY}</div><div class='sharebuttons'>s</div>", f"h {STORY}"),
    ],
)
def test_whole_story_and_nothing_else(page, text):
    assert html.main_text(page) == text.strip()
