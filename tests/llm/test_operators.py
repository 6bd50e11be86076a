"""Operators against brute force on small rows: nulls, empty and long texts, ties, clashing names."""

import hashlib
import re
from collections import Counter
from types import SimpleNamespace
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm import common, fingerprints, packing, quality, sharding, simhash, substring, toxicity, unigram, urls
from packetloom.llm.common import Scratch, components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]


def words(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.integers(90)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Null and empty texts, repeated rows, copies, near copies and a passage inside others."""
    rng = np.random.default_rng(4)
    base, passage = words(rng, 120), words(rng, 70)
    near = base.split()
    near[7] = "other"
    texts = [base, base, " ".join(near), None, "", "  \n", "one", words(rng, 60) + " " + passage + " " + words(rng, 50), words(rng, 40) + " " + passage + "\n" + words(rng, 90), words(rng, 6000), "A " * 200, "a\nb\na\nb", "ü é 日本 😀 " * 30]
    out = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    return [*out, out[0], (None, "lost id", None, None, 7)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def base_measures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = list(zip(w, w[1:], w[2:]))
    many, hit = Counter(grams), set()
    for k, g in enumerate(grams):
        if many[g] > 1:
            hit |= {k, k + 1, k + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_quality_measures(docs, rows, none):
    got = sorted((tuple(r[:6]) for r in quality.clean_lines(docs.withColumn("kept", F.lit("x"))).select(*quality.BASE).collect()))
    assert got == sorted(base_measures(r[1]) for r in rows)
    clash = quality.clean_lines(docs.toDF("t__", "text", "w__", "h__", "g__")).orderBy("t__")
    assert clash.columns[:5] == ["t__", "text", "w__", "h__", "g__"] and clash.select("t__", "text").collect() == docs.orderBy("doc_id").select("doc_id", "text").collect()
    assert quality.clean_lines(none).count() == 0


def test_quality_verdicts(spark):
    good = " ".join(f"word{k} and" for k in range(60)) + "."
    nav = " | ".join(f"item{k}" for k in range(60))
    rows = [(1, good), (2, nav), (3, good + "\n" + nav[:60]), (4, " ".join(f"w{k}%%%" for k in range(60))), (5, good + "\nAll rights reserved"), (6, "WORD ABC!! " * 1 + " ".join(f"CAPS{k}X" for k in range(60)))]
    got = {r.doc_id: (r.kept, r.clean_text) for r in quality.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k][0] for k in range(1, 7)] == [True, False, True, False, True, False]
    assert got[3][1] == good and got[5][1] == good


def test_urls(spark):
    pages = [(1, "https://www.Example.COM/en/1"), (2, "http://example.com/en/77?x"), (3, "nonsense"), (4, None), (5, "http://a.net/x.html"), (6, "http://www.a.net/x/#t"), (7, "http://b.org/y"), (8, "http://m.example.net/de/81"), (8, "http://m.example.net/de/81"), (9, "")]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit(1))
    listed = spark.createDataFrame([("a.net/x",), (None,), ("other.net/q",)], "c string")
    got = sorted({(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, listed).collect()})
    assert got == sorted({(1, "www.example.com", "/en/1", "com/en/", "block"), (2, "example.com", "/en/77", "example.com/en/7", "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "a.net", "/x.html", None, "block"), (6, "www.a.net", "/x/", None, "block"), (7, "b.org", "/y", None, "allow"), (8, "m.example.net", "/de/81", "example.net/de/8", "block"), (9, "", "", None, "allow")})
    assert urls.filter_urls(df, listed).count() == 10
    shuffled = urls.filter_urls(df, listed, broadcast_blocks=0)
    assert sorted(shuffled.select("page_id", "verdict").collect()) == sorted(urls.filter_urls(df, listed).select("page_id", "verdict").collect())
    assert urls.filter_urls(df.limit(0), listed).count() == 0 and urls.repeated_urls(df).count() >= 1


def test_sharding(docs, rows, none):
    made = sharding.shuffle_into_shards(docs.withColumn("slot", F.lit("x")), 5, bucket_bytes=2000).collect()
    assert len(made) == len(rows) and sorted(str(r.text) for r in made) == sorted(str(r[1]) for r in rows)
    for s in {r.shard for r in made}:
        assert sorted(r.slot for r in made if r.shard == s) == list(range(sum(r.shard == s for r in made)))
    more = {r.doc_id: r.shard for r in sharding.shuffle_into_shards(docs, 6).collect()}
    assert all(r.grown_shard == more[r.doc_id] and r.grown_shard in (r.shard, 5) for r in made)
    assert all(r["size"] == len((r.text or "").encode()) + 8 for r in made)
    assert sharding.shuffle_into_shards(none).count() == 0


def test_packing(spark, docs, rows, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    made = packing.pack_best_fit(docs, path).collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids) + 1
        want.update((doc_id, k, s, min(2048, n - s)) for k, s in enumerate(range(0, n, 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in made) == want
    for s in {r.sequence_id for r in made}:
        own = sorted((r.offset, r.length) for r in made if r.sequence_id == s)
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)]).tolist()[:-1] and sum(n for _, n in own) <= 2048
    assert packing.pack_best_fit(none, path).count() == 0


def test_ids_survive_beside_null(spark, vocabulary):
    """Ids beyond 2 ** 53 next to a null one, clashing columns, and the digests of pieces."""
    from tokenizers import Tokenizer
    from zlib import crc32

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    big, long = 2**53 + 1, " ".join(f"w{k} and" for k in range(3000))
    rows = [(big, "one two"), (None, "three"), (big + 2, long), (-big, None)]
    df = spark.createDataFrame([(k, x, 5, "r") for k, x in rows], "doc_id long, text string, piece long, ids string")
    made = packing.pack_best_fit(df, path).collect()
    want = Counter()
    for k, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want.update((k, i, len(ids[at : at + 2048]), crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for i, at in enumerate(range(0, len(ids), 2048)))
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in made) == want
    encoded = unigram.encode_texts(df, vocabulary).select("doc_id", "decoded", unigram.ids_digest().alias("crc"), "ids").collect()
    assert {(r.doc_id, r.decoded) for r in encoded} == {(k, x or "") for k, x in rows}
    assert all(r.crc == crc32(" ".join(map(str, r.ids)).encode()) for r in encoded)
    assert {r.doc_id for r in unigram.count_tokens(df, vocabulary).collect()} == {k for k, _ in rows}


def test_packing_is_near_the_bound(spark):
    """Sequences of 2,048 by the lengths that real texts have: a third short, some at the limit."""
    rng = np.random.default_rng(32)
    lengths = Counter(np.minimum(2048, np.concatenate([rng.lognormal(6, 1, 20_000), rng.integers(1, 60, 5000), np.full(3000, 2048)]).astype(int) + 1).tolist())
    plan = packing.plan_patterns(dict(lengths))
    least = max(-(-sum(k * n for k, n in lengths.items()) // 2048), sum(n for k, n in lengths.items() if k > 1024))
    assert sum(n for _, n in plan) <= 1.002 * least


def test_chunks_equal_whole_texts():
    from pathlib import Path

    chunks = packing.ChunkIds(Path(public_tokenizers.path("word_bpe_49k.json")).read_text())
    for text in ["Don't stop, it's 5.5% off...", "<|endoftext|> A,B", "<|ENDOFTEXT|> a", "É́ İstanbul, ΣΑΣ. x\x1fy z", "a,, b., \"c,\" 日本,", "naïve,\tCAFÉ."]:
        assert np.frombuffer(chunks.of(text), "<u4").tolist() == chunks.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = Counter(rng.integers(1, 65, 400).tolist())
    plan = packing.plan_patterns(dict(counts), 64)
    used = Counter()
    for pattern, n in plan:
        assert sum(pattern) <= 64 and n > 0
        for x in pattern:
            used[x] += n
    assert used == counts
    least = max(-(-sum(k * n for k, n in counts.items()) // 64), sum(n for k, n in counts.items() if k > 32))
    assert sum(n for _, n in plan) <= 1.06 * least


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    runs = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(runs))


def test_simhash_components(docs, rows, none):
    made = simhash.simhash_components(docs)
    prints = [brute_fingerprint(r[1]) for r in rows]
    up = list(range(len(rows)))
    for _ in rows:
        up = [min(up[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 2) for i in range(len(rows))]
    want = Counter()
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if up[j] == up[i] and rows[j][0] is not None]
        want[r[0], f"{prints[i]:016x}", min(ids, default=None)] += 1
    assert Counter(map(tuple, made.collect())) == want
    assert simhash.simhash_components(none).count() == 0


@pytest.mark.parametrize("blocks", [1, 4, 8])
def test_tiles_lose_no_link(spark, blocks):
    rng = np.random.default_rng(blocks)
    base = rng.integers(-(2**63), 2**63, 60)
    fps = sorted({int(x) for b in base for x in (b, b ^ np.int64(1 << int(rng.integers(63))), b ^ np.int64(5 << int(rng.integers(60))))})
    nodes = spark.createDataFrame([(f, f, 1) for f in fps], "id long, fp long, size int")
    with Scratch(spark) as scratch:
        links = [(r.a, r.b) for r in simhash.fingerprint_links(nodes, scratch, 2, blocks).collect()]
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 2
        up[root(a)] = root(b)
    for a in fps:
        for b in fps:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                assert root(a) == root(b)


def test_near_copies(docs, none):
    got = {r.doc_id: r.class_id for r in simhash.near_copies(docs).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[3] == got[4] == 3 and got[9] == 9 and None not in got
    tight = {r.doc_id: r.class_id for r in simhash.near_copies(docs, most=1).collect()}
    assert tight == got
    assert simhash.near_copies(none).count() == 0


def hub(rng, size, variants, edits):
    """A text and variants of it: all are like the first, most are unlike each other."""
    base = words(rng, size).split()
    out = [" ".join(base)]
    for k in range(variants):
        own = list(base)
        for e, at in enumerate(rng.choice(size // 6, edits, replace=False) * 6 + 2):
            own[at] = f"new{k}x{e}"
        out.append(" ".join(own))
    return out


def brute_classes(texts, width=5, similarity=0.8):
    """The smallest position that chains of similar texts reach, by all pairs."""
    sets = [{tuple(t.split()[k : k + width]) for k in range(len(t.split()) - width + 1)} for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return label


def test_near_copies_of_a_hub(spark):
    texts = hub(np.random.default_rng(12), 300, 60, 6)
    ids = [*range(1, 61), 0]
    df = spark.createDataFrame([(k, texts[k]) for k in ids], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in simhash.near_copies(df).collect()}
    assert set(brute_classes(texts)) == {0} and [got[k] for k in range(61)] == [0] * 61


def test_near_copies_with_inner_repeats(spark):
    rng = np.random.default_rng(13)
    text, other, part = words(rng, 200), words(rng, 150), words(rng, 40)
    texts = [text, text + " " + text, other + " " + part, other + " " + " ".join([part] * 12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert brute_classes(texts) == [0, 0, 2, 2]
    assert {r.doc_id: r.class_id for r in simhash.near_copies(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}


def test_near_copies_at_the_bound(spark):
    rng, texts = np.random.default_rng(14), []
    for k in range(100):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 154)]
        texts += [" ".join(base), " ".join([*base[16:], *(f"n{k}x{x}" for x in range(16))])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in simhash.near_copies(df).collect()}
    assert [got[k] for k in range(200)] == brute_classes(texts) == [k // 2 * 2 for k in range(200)]


def test_first_copies_go_by_text(spark):
    import corpus_pipeline

    rng = np.random.default_rng(15)
    a, b, c, d, e = (words(rng, 100) for _ in range(5))
    rows = [(1, a), (2, a + " more"), (2, b), (2, b), (3, c), (3, d), (None, e), (None, a), (None, e), (None, None), (4, None), (5, "")]
    df = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], DOCS)
    left = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect())
    assert left == Counter([(1, a), (2, b), (3, c), (3, d), (None, e), (None, a), (None, e), (None, None), (4, None)])


def test_substring_dedup(docs, rows, none):
    spans = substring.repeated_spans(docs).collect()
    by_doc = {s.doc_id: s for s in spans}
    assert by_doc[1].n_words == 120 and by_doc[1].kept_doc_id == 0 and 2 in by_doc and 0 not in by_doc and 9 not in by_doc
    assert (by_doc[8].first_word, by_doc[8].n_words, by_doc[8].kept_doc_id) == (40, 70, 7) and 7 not in by_doc
    left = substring.remove_spans(docs, substring.repeated_spans(docs)).collect()
    assert len(left) == len(rows)
    for r in left:
        if r.doc_id == 1:
            assert r.text == ""
        elif r.doc_id not in by_doc:
            assert r.text == next(x[1] for x in rows if x[0] == r.doc_id)
    assert substring.repeated_spans(none).count() == 0


@pytest.mark.parametrize("block", [1024, 16])
def test_substring_buckets_are_checked_whole(spark, monkeypatch, block):
    monkeypatch.setattr(substring, "BLOCK", block)
    texts = hub(np.random.default_rng(16), 100, 80, 2)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {s.doc_id: (s.first_word, s.n_words, s.kept_doc_id) for s in substring.repeated_spans(df).collect()}
    # Bands find a pair of 0.81 with a probability of 0.986; a text that they miss has the windows that are equal.
    assert set(brute_classes(texts)) == {0} and sum(got[k] == (0, 100, 0) for k in range(1, 81)) >= 76 and set(got) == set(range(1, 81))


def test_repeated_ids_and_clashing_names(spark):
    """Texts that share a doc_id, rows without one, ids beyond 2 ** 53 and columns named like inner ones."""
    rng = np.random.default_rng(21)
    a, b, c = (words(rng, n) for n in (120, 60, 90))
    big = 2**53 + 1
    rows = [(5, a), (5, b + " " + a), (5, "short"), (big, a + " " + c), (None, a), (None, None), (big + 1, None), (7, ""), (7, c + " " + b)]
    df = spark.createDataFrame([(k, t, k, "x", 1) for k, t in rows], "doc_id long, text string, key__ long, spans__ string, cut_words int").withColumn("text__", F.lit("y"))
    spans = substring.repeated_spans(df)
    left = Counter((r.doc_id, r.text, r.key__, r.cut_words) for r in substring.remove_spans(df, spans).collect())
    firsts = min((r.text_key, r.kept_doc_id) for r in spans.collect())
    assert firsts[1] in (5, 7) and len(left) == len(rows)
    whole = {(k, t) for k, t in rows}
    kept = {(k, t) for k, t, _, n in left if n == 0}
    assert kept <= whole and {(None, a), (None, None), (big + 1, None), (7, ""), (5, "short")} <= kept
    assert sum(t is not None and a in t for (k, t) in kept if k is not None) == 1 and all(k == x for k, _, x, _ in left)


def test_windows_lie_in_every_passage():
    rng = np.random.default_rng(22)
    known = substring.WordHashes()
    for _ in range(200):
        passage = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 50))
        texts = [" ".join([*(f"v{x}" for x in rng.integers(0, 10**6, rng.integers(0, 90))), passage, *(f"u{x}" for x in rng.integers(0, 10**6, rng.integers(0, 90)))]) for _ in range(2)]
        units = substring.group_units(np.array([1, 2]), np.array([1, 2]), texts, known, 25).to_pylist()
        assert {u["content"] for u in units if u["doc_id"] == 1} & {u["content"] for u in units if u["doc_id"] == 2}


def test_units_do_not_depend_on_their_neighbours():
    rng = np.random.default_rng(23)
    texts = [words(rng, int(n)) for n in rng.integers(0, 160, 40)] + ["", "a", " \n "]
    known = substring.WordHashes()
    of = lambda some: [{k: v for k, v in u.items()} for u in substring.group_units(np.array([i for i, _ in some]), np.array([i for i, _ in some]), [t for _, t in some], known, 25).to_pylist()]
    together = Counter(map(str, of(list(enumerate(texts)))))
    assert together == sum((Counter(map(str, of([x]))) for x in enumerate(texts)), Counter())


def test_bands_find_similar_lines():
    """Recall of the bands over pairs of lines with an exact similarity of 0.8 or more."""
    rng, hit, n = np.random.default_rng(24), 0, 0
    known = substring.WordHashes()
    while n < 400:
        base = [f"w{x}" for x in rng.integers(0, 10**6, 100)]
        other = list(base)
        for at in rng.choice(96, 2, replace=False):
            other[at] = "new"
        a, b = ({tuple(x[k : k + 5]) for k in range(96)} for x in (base, other))
        if not 0.8 <= len(a & b) / len(a | b) < 0.9:
            continue
        units = [u for u in substring.group_units(np.array([1, 2]), np.array([1, 2]), [" ".join(base), " ".join(other)], known, 25).to_pylist() if u["n_words"] > substring.WINDOW]
        n += 1
        hit += any(units[0][f"b{k}"] == units[1][f"b{k}"] for k in range(substring.BANDS))
    assert hit >= 0.96 * n


def test_very_long_texts(spark):
    """A megabyte of text, and one without a blank."""
    rng = np.random.default_rng(25)
    long = words(rng, 150_000)
    passage = " ".join(long.split()[70_000:70_080])
    rows = [(1, long), (2, words(rng, 30) + " " + passage + " " + words(rng, 30)), (3, "x" * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.first_word, r.n_words, r.kept_doc_id) for r in substring.repeated_spans(df).collect()]
    assert got == [(2, 30, 80, 1)]
    assert {r.doc_id: r.class_id for r in simhash.near_copies(df).collect()} == {1: 1, 2: 2, 3: 3}
    assert {r.doc_id: r.component_id for r in simhash.simhash_components(df).collect()} == {1: 1, 2: 2, 3: 3}


def test_fingerprints(spark, docs, rows, none):
    rows = [r for r in rows if r[0] is not None][:-1]
    df = spark.createDataFrame(rows, DOCS)
    for size in (2, 2000):
        got = {r.doc_id: r for r in fingerprints.fingerprint_documents(df, rows_per_part=size).collect()}
        texts = [r[1] or "" for r in rows]
        for k, (r, t) in enumerate(zip(rows, texts)):
            q, after = len(t) // 4, texts[(k + 1) % len(texts)]
            edited = t[: len(t) - q] + after[:q]
            assert got[r[0]].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[r[0]].n_chars == len(t)
            assert 0 <= got[r[0]].near_edited <= 1 and 0 <= got[r[0]].near_next <= 1
        assert got[0].fingerprint == got[1].fingerprint and got[0].near_next == 1 and got[3].near_next == 1
    assert fingerprints.fingerprint_documents(none).count() == 0 and fingerprints.fingerprint_documents(docs).count() == 15


def test_peeling_recovers_differences(spark):
    rng = np.random.default_rng(3)
    rows = [([int(x) for x in a], [int(x) for x in b]) for a, b in ((c[: n + d], np.concatenate([c[:n], c[n + d : n + 2 * d]])) for n, d in ((5, 0), (40, 3), (10, 6), (60, 40)) for c in [rng.integers(-(2**63), 2**63, n + 2 * d)])]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    cells = df.selectExpr("*", *[f"{fingerprints.sketch(x, n)} AS {x}{n}" for x in "ab" for n in ("16", "2", "1")])
    got = cells.select(F.expr(fingerprints.decode("a16", "b16", "16")).alias("d"), F.expr("size(a) - size(array_intersect(a, b))").alias("n"), F.expr(fingerprints.decode("a1", "b1", "1")).alias("small"), F.expr(fingerprints.fold("a16", "16", "2")).alias("f"), "a2").collect()
    assert [(r.d.a, r.d.b) for r in got] == [(r.n, r.n) for r in got]
    assert got[3].small is None and all(r.f == r.a2 for r in got)
    sized = df.selectExpr(f"{fingerprints.tables_for('a')} AS t", "a").collect()
    for r in sized:
        alone = spark.createDataFrame([(r.a, [])], "a array<long>, b array<long>").selectExpr(f"{fingerprints.sketch('a', str(r.t))} AS x", f"{fingerprints.sketch('b', str(r.t))} AS y")
        d = alone.select(F.expr(fingerprints.decode("x", "y", str(r.t))).alias("d")).first().d
        assert (d.a, d.b) == (len(r.a), 0)


def brute_paragraphs(spark, texts):
    """Sets of paragraphs by plain code over the engine's hash of strings and arrays."""
    parts = [[x.strip(" ") for x in re.findall(r"[^.!?\n]{1,200}", t) if x.strip(" ")] for t in texts]
    flat = spark.createDataFrame([(i, j, x) for i, p in enumerate(parts) for j, x in enumerate(p)], "i int, j int, x string").select("i", "j", F.xxhash64("x").alias("h")).orderBy("i", "j").collect()
    runs = []
    for i in range(len(texts)):
        own, run = [r.h for r in flat if r.i == i], []
        for k, h in enumerate(own):
            run.append(h)
            if h & fingerprints.GRAIN == 0 or k == len(own) - 1:
                runs.append((i, tuple(run)))
                run = []
    return [{r for j, r in runs if j == i} for i in range(len(texts))]


def test_likeness_is_that_of_the_paragraphs(spark):
    rng = np.random.default_rng(31)
    sentence = lambda: words(rng, int(rng.integers(3, 12))) + "."
    texts = [" ".join(sentence() for _ in range(n)) for n in (1, 5, 30, 30, 200, 200, 3)] + ["", "no stop " * 300, None, "x" * 3000]
    texts[3] = texts[2] + " " + sentence()
    texts[5] = texts[4][: len(texts[4]) // 2] + " changed. " + texts[4][len(texts[4]) // 2 :]
    df = spark.createDataFrame([(10 * k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(df, rows_per_part=3).collect()}
    plain = [t or "" for t in texts]
    edited = [t[: len(t) - len(t) // 4] + plain[(k + 1) % len(plain)][: len(t) // 4] for k, t in enumerate(plain)]
    own, changed = brute_paragraphs(spark, plain), brute_paragraphs(spark, edited)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k in range(len(texts)):
        assert abs(got[10 * k].near_edited - like(own[k], changed[k])) < 1e-9 and abs(got[10 * k].near_next - like(own[k], own[(k + 1) % len(own)])) < 1e-9
    assert got[40].near_next > 0.9 and got[20].near_next > 0.8


def test_fingerprints_of_a_hot_id(spark):
    """An id that fills several ranges is split; the order stays total."""
    rows = [(7, f"text {k}. more {k}") for k in range(60)] + [(k, f"own {k}.") for k in range(20, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.fingerprint_documents(df, rows_per_part=5).collect()
    order = [r.t for r in df.select("doc_id", F.col("text").alias("t"), F.shiftrightunsigned(F.xxhash64("text"), 1).alias("u")).orderBy("doc_id", "u", "t").collect()]
    want = Counter(hashlib.sha256((t[: len(t) - len(t) // 4] + order[(k + 1) % len(order)][: len(t) // 4]).encode()).hexdigest() for k, t in enumerate(order))
    assert Counter(r.edited_sha256 for r in got) == want


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.rank_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def library(vocabulary):
    """The same pieces and scores in the public library, as a unigram model."""
    import struct

    import sentencepiece

    def number(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    def block(field, data):
        return number(field << 3 | 2) + number(len(data)) + data

    out = b""
    for i, (p, u) in enumerate(zip(vocabulary.pieces, vocabulary.units)):
        kind = 1 if u is not None else 6 if i in vocabulary.byte_ids else 2 if p == "<unk>" else 3
        out += block(1, block(1, p.encode()) + b"\x15" + struct.pack("<f", (u or 0) / unigram.UNIT) + b"\x18" + number(kind))
    out += block(2, b"\x18\x01" + number(35 << 3) + b"\x01") + block(3, block(1, b"identity") + b"\x18\x01\x20\x00")
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def test_unigram_equals_the_library(spark, docs, rows, none, vocabulary):
    model = library(vocabulary)
    counted = {r.doc_id: r.n_tokens for r in unigram.count_tokens(docs, vocabulary).collect()}
    encoded = {r.doc_id: r for r in unigram.encode_texts(docs, vocabulary).collect()}
    for doc_id, text, *_ in rows:
        want = model.encode(text or "")
        assert counted[doc_id] == len(want) and list(encoded[doc_id].ids) == want and encoded[doc_id].decoded == (text or "") == model.decode(want)
    assert unigram.count_tokens(none, vocabulary).count() == 0 == unigram.encode_texts(none, vocabulary).count()


def test_toxicity(spark, none):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for k in range(600):
        bad = k % 4 == 0
        text = words(rng, 40) + (f" vile{k % 3} " + words(rng, 20) if bad else "")
        rows.append((k, text, "en" if k % 2 else "de", "s", len(text)))
        labels.append((k, 1, int(bad)))
    docs = spark.createDataFrame([*rows, (None, None, None, None, 0), (601, "", "fr", "s", 0)], DOCS)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs.withColumn("score", F.lit("x")), known, steps=300).withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()}
    held = [k for k in range(600) if got[k].held]
    assert np.mean([(got[k].score >= 0.5) == (k % 4 == 0) for k in held]) > 0.95
    assert 0 <= got[601].score < 0.5 and len(got) == 602
    assert toxicity.score_toxicity(none, known, steps=5).count() == 0
    assert toxicity.score_toxicity(docs, known.limit(0), steps=5).where("score >= 0.5").count() == 0


def test_forward_pass_is_that_of_plain_loops():
    rng = np.random.default_rng(33)
    model = toxicity.Model()
    for k in ("b1", "b2", "b3", "c"):
        model.p[k] += rng.normal(0, 0.2, model.p[k].shape).astype(np.float32)
    for text in ("", "one", "one two", words(rng, 40)):
        rows = toxicity.word_rows(toxicity.WordRows(), text)
        total = float(model.p["c"][0])
        for k, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = 0.0
                for at in range(len(rows) - max(toxicity.WIDTHS) + 1):
                    own = sum(float((model.p["e"][rows[at + j, 0]] + model.p["e"][rows[at + j, 1]]) @ model.p[f"w{w}"][j * toxicity.DIM : (j + 1) * toxicity.DIM, f]) for j in range(w))
                    best = max(best, own + float(model.p[f"b{w}"][f]))
                total += best * float(model.p["v"][k * toxicity.FILTERS + f])
        assert abs(model.score(rows) - 1 / (1 + np.exp(-total))) < 1e-5


@pytest.mark.parametrize("seed", range(4))
def test_threshold_has_the_best_f1(seed):
    rng = np.random.default_rng(seed)
    scores, labels = rng.integers(5, 95, 60) / 100, rng.integers(0, 2, 60)
    f1 = lambda t: 2 * (labels[scores >= t]).sum() / ((scores >= t).sum() + labels.sum())
    assert f1(toxicity.best_threshold(scores, labels)) == max(f1(t) for t in scores)


def test_toxicity_sample_is_bounded_and_steady(spark):
    """Labels that disagree, ids that repeat and a text beyond the bound give one training set."""
    rng = np.random.default_rng(34)
    rows = [(k, words(rng, 30) + (" vile" if k % 3 == 0 else ""), "en") for k in range(200)] + [(5, "other text", "en"), (None, "vile", "en"), (300, "long " * 5000, "en")]
    labels = [(k, 1, int(k % 3 == 0)) for k in range(200)] + [(3, 1, 0), (6, 0, 0), (300, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    first = [toxicity.score_toxicity(docs.repartition(n), known.repartition(n), doc_id="id", steps=40, sample_chars=20_000).orderBy("id", "text").collect() for n in (2, 5)]
    assert [r.score for r in first[0]] == [r.score for r in first[1]] and len(first[0]) == len(rows)


@pytest.mark.parametrize("chars", [400, 40])
def test_toxicity_learns_from_every_labelled_row(spark, chars):
    """Every text is a word of its own, so each one that trains moves its word's embedding."""
    rows = [(k, f"u{k}q", "en" if k % 2 else "de") for k in range(300)] + [(300, "longest" * 100, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k, *_ in rows], "doc_id long, quality int, toxic int")
    model, thresholds = toxicity.train(docs, known, steps=1, sample_chars=chars)
    fold, cache, first = {k: crc32(str(k).encode()) % 5 for k, *_ in rows}, toxicity.WordRows(), toxicity.Model()
    at = {k: toxicity.word_rows(cache, t) for k, t, _ in rows}
    moved = {k for k in at if (model.p["e"][at[k][0, 0]] != first.p["e"][at[k][0, 0]]).any()}
    assert moved >= {k for k in at if fold[k] > 1}
    for lang in ("de", "en"):
        checked = [k for k, _, name in rows if fold[k] == 1 and name == lang]
        scores = np.array([model.score(at[k]) for k in checked])
        assert thresholds[lang] == pytest.approx(toxicity.best_threshold(scores, np.array([int(k % 3 == 0) for k in checked])), abs=1e-12)


def test_long_texts_score_alike():
    model, cache = toxicity.Model(), toxicity.WordRows()
    text = " ".join(f"w{k}" for k in range(500))
    whole = model.score(toxicity.word_rows(cache, text))
    step, toxicity.STEP = toxicity.STEP, 64
    try:
        assert abs(model.score(toxicity.word_rows(cache, text)) - whole) < 1e-6
    finally:
        toxicity.STEP = step


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    copy = words(rng, 150)
    texts = [copy, copy, *(words(rng, 120) for _ in range(20)), "short"]
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, k % 2) for k in range(5)], T.StructType.fromDDL("doc_id long, quality int, toxic int")).limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {0, *range(2, 22)}


def brute_lines(text):
    """The lines of a text that pass, by the rules in plain words; and the characters lost and had."""
    kept, lost, had = [], 0, 0
    for line in (text or "").split("\n"):
        bare = re.sub(r"[\x20\x09-\x0D]", "", line)
        if not bare:
            continue
        had += len(bare)
        symbols, bars = sum(c in "#*$%&|<>!^~=\\{}" for c in line), sum(c in "|>»•" for c in line)
        letters, capitals = sum(c.isalpha() for c in line), sum(c.isupper() for c in line)
        bad = 100 * symbols > 10 * len(bare) or (bars >= 3 and 3 * bars >= len(line) - len(bare) + 1) or (letters >= 20 and 100 * capitals > 60 * letters) or any(p in line.lower() for p in quality.BOILERPLATE)
        if bad:
            lost += len(bare)
        else:
            kept.append(line)
    return "\n".join(kept), lost, had


def brute_spans(rows, least_words=25, least_run=40):
    """Repeated spans of (doc_id, text) by all pairs of paragraphs and words compared one by one."""
    known = substring.WordHashes()
    ids = np.array([k for k, _ in rows])
    units = substring.group_units(ids, ids, [t for _, t in rows], known, least_words).to_pylist()
    texts = {k: substring.text_words(t) for k, t in rows}
    sets = []
    for u in units:
        w = texts[u["doc_id"]][u["first_word"] : u["first_word"] + u["n_words"]]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    label = list(range(len(units)))
    for i in range(len(units)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    first = {}
    for x, u in zip(label, units):
        first[x] = min(first.get(x, (u["doc_id"], u["first_word"], u["n_words"])), (u["doc_id"], u["first_word"], u["n_words"]))
    found = {}
    for x, u in zip(label, units):
        d, a, n = u["doc_id"], u["first_word"], u["n_words"]
        fd, fa, fn = first[x]
        if (d, a, n) == (fd, fa, fn) or (d == fd and a < fa + fn):
            continue
        lo, hi = a, a + n
        if n == fn == substring.WINDOW:
            while a - lo < 35 and lo > 0 and fa - (a - lo) > 0 and texts[d][lo - 1] == texts[fd][fa - (a - lo) - 1]:
                lo -= 1
            while hi - a - n < 35 and hi < len(texts[d]) and fa + hi - a < len(texts[fd]) and texts[d][hi] == texts[fd][fa + hi - a]:
                hi += 1
        found.setdefault(d, []).append((lo, hi, n > substring.WINDOW))
    out = set()
    for d, spans in found.items():
        merged = []
        for lo, hi, line in sorted(spans):
            if merged and lo <= merged[-1][1]:
                merged[-1] = [merged[-1][0], max(hi, merged[-1][1]), line or merged[-1][2]]
            else:
                merged.append([lo, hi, line])
        out |= {(d, lo, hi - lo) for lo, hi, line in merged if line or hi - lo >= least_run}
    return out


def corpus(rng):
    """Documents of every kind that the stages of the pipeline tell apart."""
    def prose(n):
        w = words(rng, n).split()
        return "\n".join(" ".join(w[k : k + 40]) for k in range(0, n, 40))

    passage, base = words(rng, 60), prose(200)
    near = base.split(" ")
    near[50] = "changed"
    texts = [prose(int(n)) for n in rng.integers(80, 200, 24)]
    texts += [base, base, " ".join(near), prose(60) + " " + passage + " " + prose(60), prose(70) + " " + passage + "\n" + prose(80), "short", None, "", prose(100) + "\nAll rights reserved", "\n".join(" | ".join(f"x{k}" for k in range(30)) for _ in range(4)), prose(90) + " vile1 " + prose(20), prose(60) + " " + passage + " " + prose(40)]
    texts += [prose(60) + (" vile0 vile2 " if k % 2 else " ") + prose(30) for k in range(60)]
    return [(k, t, "en" if k % 3 else "de", "s", len(t or "")) for k, t in enumerate(texts)]


def test_substring_equals_all_pairs(spark):
    rng = np.random.default_rng(41)
    rows = [(k, t) for k, t, *_ in corpus(rng) if t][:36]
    hub_texts = hub(rng, 60, 6, 1)
    rows += [(100 + k, t) for k, t in enumerate(hub_texts)]
    got = {(r.doc_id, r.first_word, r.n_words) for r in substring.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_spans(rows) and len(got) > 6


def test_each_stage_equals_plain_code(spark, tmp_path, monkeypatch):
    """Every stage of the pipeline on the rows that its predecessor kept, against plain code."""
    import corpus_pipeline

    rng = np.random.default_rng(42)
    rows = corpus(rng)
    toxic = {k: int("vile" in (t or "")) for k, t, *_ in rows}
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, y) for k, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def after(name, before):
        stages[name](spark, before, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        made = spark.read.parquet(f"{tmp_path}/{name}")
        return made, sorted((r.doc_id, r.text) for r in made.collect()) if "text" in made.columns else made.collect()

    docs, got = after("quality_rules", docs)
    want = []
    for k, t, *_ in rows:
        clean, lost, had = brute_lines(t)
        if not base_measures(t)[5] and 100 * lost <= 40 * had:
            want.append((k, clean))
    assert got == sorted(want) and docs.columns == [f.split()[0] for f in DOCS.split(", ")]

    model, thresholds = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    langs = {k: lang for k, _, lang, *_ in rows}
    want = [(k, t) for k, t in got if model.score(toxicity.word_rows(toxicity.WordRows(), t)) < thresholds.get(langs[k], 0.5)]
    docs, got = after("toxicity", docs)
    assert got == want and sum(toxic[k] for k, _ in got) < sum(toxic[k] for k, *_ in rows) / 3

    label = brute_classes([t for _, t in got])
    want = [x for i, x in enumerate(got) if label[i] == i]
    assert len(want) < len(got)
    docs, got = after("simhash_near_dedup", docs)
    assert got == want

    spans = {}
    for d, a, n in brute_spans(got):
        spans.setdefault(d, []).append((a, n))
    assert spans
    want = [(k, substring.cut_spans(t, spans[k]) if k in spans else t) for k, t in got]
    docs, got = after("substring_dedup", docs)
    assert got == sorted(x for x in want if x[1].split())

    _, packed = after("best_fit_packing", docs)
    assert {r.doc_id for r in packed} == {k for k, _ in got}
    for s in {r.sequence_id for r in packed}:
        own = sorted((r.offset, r.length) for r in packed if r.sequence_id == s)
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)]).tolist()[:-1] and sum(n for _, n in own) <= 2048


def test_components_have_every_node(spark):
    links = [(5, 9), (9, 7), (7, 3), (20, 21), (3, 3), (None, 4), (30, 31), (31, 32), (30, 32)]
    with Scratch(spark) as scratch:
        got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    assert got == {5: 3, 9: 3, 7: 3, 3: 3, 20: 20, 21: 20, 30: 30, 31: 30, 32: 30}


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_components_of_few_links_take_few_jobs(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_LINKS", few)
    rng, tracker = np.random.default_rng(8), spark.sparkContext.statusTracker()
    chain, star = [(k, k + 1) for k in range(300)], [(1000, 1001 + k) for k in range(300)]
    links = [*chain, *star, *(rng.integers(2000, 2400, (260, 2)).tolist())]
    links = [links[k] if k % 2 else links[k][::-1] for k in rng.permutation(len(links)).tolist()]
    near = {x: {x} for link in links for x in link if link[0] != link[1]}
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    least = {}
    for x in sorted(near):
        todo = [] if x in least else [x]
        while todo:
            if (y := todo.pop()) not in least:
                least[y] = x
                todo += near[y]
    spark.sparkContext.setJobGroup(f"components-{few}", "")
    with Scratch(spark) as scratch:
        got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    jobs = len(tracker.getJobIdsForGroup(f"components-{few}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == least
    assert not few or jobs <= 8, jobs


def test_native_memory_of_the_driver_goes_back(spark, monkeypatch):
    assert common.trim_native(spark)
    trimmed = []
    monkeypatch.setattr(common, "trim_native", trimmed.append)
    Scratch(spark).tidy()
    apart = SimpleNamespace(sparkContext=SimpleNamespace(master="local-cluster[3,2,3000]"), _jvm=spark._jvm)
    Scratch(apart).tidy()
    assert trimmed == [apart]


def test_workers_release_memory_after_their_rows(monkeypatch):
    done = []
    monkeypatch.setattr(common, "release_worker", lambda: done.append(len(seen)))
    seen = []
    for x in common.releasing(lambda batches: (2 * b for b in batches))(iter([1, 2, 3])):
        seen.append(x)
    assert seen == [2, 4, 6] and done == [3]
    monkeypatch.undo()
    common.release_worker()
