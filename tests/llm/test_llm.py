"""The operators against brute force, round trips and held-out data, and on odd inputs."""

import base64
import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import bpe, components, langid, langmodel, line_dedup, media, near_copies, packing, queries, simhash, suffix_dedup, topk, warc

from ..conftest import SF

TIKTOKEN = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 int, tail string"


def odd_rows():
    """Nulls in any column, empty and long texts, ties and repeated rows, columns with clashing names."""
    base = " ".join(f"word{i % 37}" for i in range(120))
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(60_000))
    texts = [None, "", " \n\t ", base, base, base + " end", "ÄÖ ß é 日本 \U0001f600", long, "a", "\n\n", "x" * 5000, "line one\nline two"]
    rows = [(i, t, ["en", None, "fr"][i % 3], [None, "s", "t.org"][i % 3], None, 1, "y") for i, t in enumerate(texts)]
    return rows + [rows[3], (None, base, None, None, 5, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{SF}/documents.parquet").to_pandas()


# 2


def reference_encoding(codec):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_bpe_is_exact(docs):
    codec = bpe.codec(TIKTOKEN, P.PATTERN)
    want = reference_encoding(codec)
    rng = np.random.default_rng(0)
    signs = list("ab cd  \n\t é'st01!$　ß日\U0001f600\x1c\x85́ the ing ")
    texts = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(3000)] + docs.text.tolist()[:60] + ["", "x" * 3000, " " * 500, "\n\n a", "don't  we'll", "<|endoftext|>"]
    ids, at = codec.encode(pa.array(texts))
    for text, a, b in zip(texts, at, at[1:]):
        assert ids[a:b].tolist() == want.encode_ordinary(text)
        assert codec.decode(ids[a:b]) == text.encode()


def test_bpe_operator_round_trip(spark, odd, none):
    back = bpe.decode(bpe.encode(odd, TIKTOKEN, P.PATTERN), TIKTOKEN, P.PATTERN).collect()
    assert collections.Counter((r[0], bytes(r[1])) for r in back) == collections.Counter((r[0], (r[1] or "").encode()) for r in odd_rows())
    assert bpe.round_trip(none, TIKTOKEN, P.PATTERN).count() == 0


def test_op2(spark, docs):
    want = reference_encoding(bpe.codec(TIKTOKEN, P.PATTERN))
    got = {r["doc_id"]: r for r in queries.op2_bpe(spark, SF).collect()}
    for i, t in zip(docs.doc_id, docs.text):
        ids = np.array(want.encode_ordinary(t or ""), "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


# 3


def brute_groups(fps, near):
    up = list(range(len(fps)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if near(fps[i], fps[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def test_anchors_cover_two_bits():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(0, 3), replace=False):
            y[i] ^= np.uint64(1 << int(b))
    sets = []
    for v in (x, y):
        at, who = simhash.anchors(v)
        held = collections.defaultdict(set)
        for a, w in zip(at.tolist(), who.tolist()):
            held[w].add(a)
        sets.append(held)
    assert all(sets[0][i] & sets[1][i] for i in range(len(x)))


def test_op3(spark, docs):
    def print_of(text):
        w = (text or "").encode().lower().split()
        runs = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))

    fps = [print_of(t) for t in docs.text]
    roots = brute_groups(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    want = {int(i): (f"{f:016x}", int(docs.doc_id[r])) for i, f, r in zip(docs.doc_id, fps, roots)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op3_simhash(spark, SF).collect()} == want


def test_simhash_full_anchor(spark, monkeypatch):
    """Anchors that too many share are compared another way, with the same groups."""
    rng = np.random.default_rng(1)
    fps = [int(rng.integers(0, 1 << 62)) ^ (1 << int(a)) ^ (1 << int(b)) for _ in range(1) for a in range(30) for b in range(20, 25)]
    fps = [fps[0] ^ (1 << (i % 40)) ^ (1 << (i // 40 * 3)) for i in range(120)]
    prints = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "doc_id long, fp long")
    first = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(prints).collect()}
    monkeypatch.setattr(simhash, "BUCKET", 1)
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_groups(prints).collect()} == first
    assert [first[i] for i in range(120)] == brute_groups(fps, lambda a, b: (a ^ b).bit_count() <= 2)


def test_simhash_odd(odd, none):
    got = simhash.simhash_dedup(odd).collect()
    assert len(got) == len(odd_rows())
    assert {r["component_id"] for r in got if r["fingerprint"] == "0" * 16} == {0}
    assert simhash.simhash_dedup(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 160)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 150: 150, 160: 150, 200: 150}


# 4


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=40).round(1)]) for i in range(300)]
    rows += [(50, rows[50][1]), (301, rows[50][1]), (302, None), (303, [1.0, None] * 20), (304, [float("nan")] * 40), (305, [float("inf")] * 40), (400, [1.0, 2.0]), (401, [3.0, 4.0]), (None, rows[0][1]), (500, [])]
    got = collections.defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, every=50).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = collections.defaultdict(list)
    for k, (i, v) in enumerate(good):
        if i is not None and i % 50 == 0:
            best = sorted((-int(v @ w), (1 << 62) if j is None else j) for m, (j, w) in enumerate(good) if m != k and len(w) == len(v))[:5]
            want[i] += [(n + 1, None if j == 1 << 62 else j, -s) for n, (s, j) in enumerate(best)]
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items() if v}


def test_op4_equals_sql(spark, duck):
    got = sorted(tuple(r) for r in queries.op4_top_k(spark, SF).select("query_id", "rank", "vec_id", "score").collect())
    assert got == sorted(duck.execute(queries.ORACLES["op4_top_k"]).fetchall())


# 5


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    ids = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for x in texts]
    crcs = collections.Counter()
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[i]) and r["ids_crc32"] == zlib.crc32(ids[i][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[i])
    assert len(by_doc) == len(texts)
    filled, padding = collections.defaultdict(list), 0
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert sorted(filled) == list(range(len(filled)))
    return padding / max(1, sum(map(len, ids))), crcs


def test_op5(spark, docs):
    share, _ = check_packing(queries.op5_packing(spark, SF).collect(), docs.text.tolist())
    assert share < 0.02


def test_packing_odd(spark, none):
    rows = odd_rows()
    share, _ = check_packing(packing.pack(spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "doc_id long, text string"), WORDS).collect(), [r[1] for r in rows])
    assert share < 0.02
    assert packing.pack(none, WORDS).count() == 0


def test_packing_of_special_strings(spark):
    texts = ["a <|endoftext|> b", "<|startoftext|>", "<|ENDOFTEXT|> x<|endoftext|><|startoftext|>y", "plain words", "one <|endoftext", None, "é<|endoftext|>é" * 900]
    check_packing(packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), WORDS).collect(), texts)


def test_packing_of_one_length(spark):
    """Rests that do not fit each other are cut, not padded."""
    text = " ".join(["a"] * 1400)
    share, _ = check_packing(packing.pack(spark.createDataFrame([(i, text) for i in range(50)], "doc_id long, text string"), WORDS).collect(), [text] * 50)
    assert share < 0.001


def test_cutting_stock_covers_demand():
    rng = np.random.default_rng(0)
    demand = {int(s): int(n) for s, n in zip(rng.choice(np.arange(1, 65), 20, replace=False), rng.integers(1, 50, 20))}
    made = collections.Counter()
    for pattern, n in packing.cutting_stock(demand, 64):
        assert sum(s * a for s, a in pattern.items()) <= 64
        for s, a in pattern.items():
            made[s] += a * n
    assert made == demand


# 6


def test_op6(spark, docs, monkeypatch):
    monkeypatch.setattr(langmodel, "HEAD", 2000)  # most words are then joined in the cluster
    got = {r["doc_id"]: r for r in queries.op6_lm_scoring(spark, SF).collect()}
    held = {int(i): zlib.crc32(str(i).encode()) % 10 == 0 for i in docs.doc_id}
    tokens = {int(i): [*(t or "").encode().lower().split(), None] for i, t in zip(docs.doc_id, docs.text)}
    c = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        base = sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    gain = [(r["score"] - r["base_score"]) / r["n_tokens"] for r in got.values() if r["held_out"]]
    assert sum(gain) / len(gain) > 0.2


def small_model(texts):
    """A model and its counts, without Spark."""
    distinct, codes, at = langmodel._tokens(pa.array(texts))
    each = langmodel._hashes(distinct)
    hashes, place = each[codes], langmodel._places(at)
    seen, begun = np.zeros(1 << 18, np.int32), np.zeros(1 << 12, np.int32)
    langmodel.gathered(hashes, place, 18, seen, begun)
    n, leaves = np.bincount(codes, minlength=len(distinct)), langmodel.leaf_of(each)
    blocks = [(b, *(v[b * n : (b + 1) * n].astype(np.int64) for v, n in ((seen, langmodel.BLOCK), (begun, langmodel.BLOCK // 64)))) for b in range(4)]
    model = langmodel.Model(np.sort(each), n[np.argsort(each)], np.bincount(leaves, n, langmodel.LEAVES), np.bincount(leaves, minlength=langmodel.LEAVES).astype(float), iter(blocks), 18)
    return model, hashes, place, seen, begun


def test_language_model_is_a_distribution():
    model, *_ = small_model(["a b c a b", "b c d", "a b c d e"])
    model.weights = np.random.default_rng(0).normal(size=model.weights.shape).astype(np.float32)
    leaves = np.arange(langmodel.LEAVES)
    before = np.array([langmodel.word_hash(w) for w in (b"a", b"b")], np.uint64)
    context = langmodel.contexts(np.append(before, np.uint64(0)), np.arange(3))[:, 2:]
    total = sum((10 ** model.log_probability(np.repeat(context, len(x), axis=1), x)).sum() for x in np.array_split(leaves, 64))
    assert total == pytest.approx(1, abs=1e-3)
    inside = (model.head_n + langmodel.SMOOTH) / 10 ** model.leaf_room[langmodel.leaf_of(model.head)]
    assert inside.max() < 1


def test_language_model_by_hand():
    """Counts, weights and probabilities of each token, one at a time."""
    texts = ["a b c a b", "b c d", "a b c d e", ""]
    model, hashes, place, seen, begun = small_model(texts)
    assert seen.sum() == begun.sum() == 7 * len(hashes)
    cells = [np.rint(16 * np.log((seen[i] + 0.3) / (begun[i // 64] / 64 + 0.3))) for i in np.flatnonzero(seen)]
    assert model.cells.ravel()[np.flatnonzero(seen)].tolist() == cells
    context, leaf = langmodel.contexts(hashes, place), langmodel.leaf_of(hashes)
    got = model.log_probability(context, leaf)
    for t in range(len(hashes)):
        fit = plain = 0.0
        for level in range(3):
            own, known = int(leaf[t]) >> (12 - 6 * level) & 63, int(leaf[t]) >> (18 - 6 * level)
            p0 = model.plain[level][known].astype(float)
            z = model.weights[level, 0] * p0
            for kind in range((3, 2, 2)[level]):
                row = model.cells[int(langmodel.rows_of(context[kind][t : t + 1], leaf[t : t + 1], level, 18)[0])].astype(float)
                z = z + row / 16 * model.weights[level, 1 + kind * 3 + int(row.max() > 23) + int(row.max() > 34)]
            fit += z[own] - np.log(np.exp(z).sum())
            plain += p0[own]
        assert got[t] == pytest.approx(np.log10(0.95 * np.exp(fit) + 0.05 * np.exp(plain)), abs=1e-4)


def test_lm_odd(odd, none):
    got = langmodel.score(odd).collect()
    assert len(got) == len(odd_rows()) and all(np.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (0, 1)} == {1}
    assert langmodel.score(none).count() == 0


# 7


def brute_removed(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raws for i in range(len(b) - length + 1))
    out = []
    for b in raws:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("group", [8192, 8])
def test_suffix_dedup(spark, docs, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = np.random.default_rng(1)
    texts = docs.text.tolist()[:60]
    p = texts[3][100:500]
    texts += [None, "", "a" * 199, "a" * 200, "a" * 201, "ab" * 300, "é" * 150, p, p[:300] + "zz", "x" + p[10:380], texts[4]]
    texts += [texts[int(rng.integers(0, 60))][:50] + p[int(rng.integers(0, 60)) :] + texts[int(rng.integers(0, 60))][:70] for _ in range(40)]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.removed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts)


def test_suffix_dedup_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 1000)
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    p = word(700)
    texts = [word(2500) + p + word(1500) + p[100:600], word(300) + p[:450], word(900)]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.removed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(3)] == brute_removed(texts)


def test_suffix_dedup_odd(odd, none):
    assert suffix_dedup.removed(odd).count() == len(odd_rows())
    assert suffix_dedup.cut_texts(odd).columns == odd.columns
    assert suffix_dedup.removed(none).count() == 0


# 1


def test_op1_equals_sql(spark, duck):
    got = sorted(repr(tuple(r)) for r in queries.op1_line_dedup(spark, SF).collect())
    assert got == sorted(repr(tuple(r)) for r in duck.execute(queries.ORACLES["op1_line_dedup"]).fetchall())


def test_line_dedup_drops_site_boilerplate_only(spark, odd, none):
    rows = [(i, f"Menu\nown line {i}\n\n Menu \nshared {i % 50}", "a") for i in range(100)] + [(200, "Menu\nother", "b")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[3] == ("own line 3\n\nshared 3", 5, 2) and got[200] == ("Menu\nother", 2, 0)
    assert line_dedup.dedup_lines(odd).count() == len(odd_rows()) and line_dedup.dedup_lines(none).count() == 0


# 8


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    model = langid.fit(d.where(fold != 0))
    rows = langid.identify_documents(d.where(fold == 0).withColumn("declared", F.lit(None).cast("string")), model, declared_col="declared").select("lang", "language", "accepted").collect()
    right = [r["lang"] == r["language"] for r in rows]
    assert sum(right) / len(right) > 0.95 and sum(r["accepted"] for r in rows) / len(rows) > 0.95


def test_language_evidence_is_fused(spark, odd, none):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    page = lambda i, u, h: (i, u, h)
    rows = [page(i, "http://a.example.fr/x", '<html lang="fr"><p>la une des eau tion entre</p>') for i in range(30)] + [page(99, "http://a.example.fr/y", '<html lang=fr><script>the the</script><p>1 x</p>'), page(100, None, None)]
    got = {r["page_id"]: r for r in langid.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert got[99]["language"] == "fr" and not got[100]["accepted"]
    assert langid.identify_documents(odd, model).count() == len(odd_rows()) and langid.identify_documents(none, model).count() == 0
    unfitted = langid.fit(none)
    assert unfitted.labels == [] and langid.identify_documents(none, unfitted).count() == 0
    judged = langid.identify_documents(odd, unfitted).collect()
    assert len(judged) == len(odd_rows()) and {r["language"] for r in judged} == {None}
    assert all(r["accepted"] == any(map(str.isalpha, r["text"] or "")) for r in judged)


def test_language_of_many_labels(spark):
    rows = [(" ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}q{i}" for i in range(20)), f"l{k:02}") for k in range(70) for _ in range(2 + (k < 64))]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.labels == sorted({r[1] for r in rows})
    assert all(model.labels[int(np.argmax(model.score(t)))] == x for t, x in rows)


# 9


def test_op9(spark, docs):
    got = {r["doc_id"]: r for r in queries.op9_media(spark, SF).collect()}
    for i, t in zip(docs.doc_id, docs.text):
        b = (t or "").encode()
        p = b + bytes(64 * max(1, -(-len(b) // 64)) - len(b))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


@pytest.mark.parametrize("kind", media.STORED)
def test_media_are_found_and_carved(spark, kind):
    payload = media.pad("Ein Text, BM und RIFF und \u0089PNG".encode() * 9)
    cell = media.store(payload, kind)
    assert media.sniff(cell) == [media.Found(kind, 0, len(cell))] and media.load(cell, media.sniff(cell)[0]) == payload
    inside = b"BM junk RIFF" + cell + b"GIF89a tail"
    assert media.sniff(inside) == [media.Found(kind, 12, len(cell))]
    assert media.sniff(cell[:-1]) == [] or kind == "wav"
    row = media.identify(spark.createDataFrame([(1, bytearray(cell), "image/gif"), (2, None, None)], "id long, cell binary, declared string"), "cell", "id", "declared").orderBy("id").collect()
    assert row[0]["confirmed"] == kind and bytes(row[0]["media"][0]["content"]) == cell and row[1]["media"] == []


def test_media_features(spark, docs):
    """Every column of the query, from what was stored."""
    got = {r["doc_id"]: r for r in queries.op9_media(spark, SF).collect()}
    seen = set()
    for i, t in zip(docs.doc_id, docs.text):
        p = media.pad((t or "").encode())
        check = zlib.crc32(p)
        stored = media.store(p, media.STORED[check % 3])
        inside, r = check // 4 % 2, got[i]
        start = check // 64 % (len(media.BEFORE) + 1) if inside else 0
        confirmed = "container" if start else media.STORED[check % 3]
        declared = media.DECLARED[check // 8 % 5]
        s = np.frombuffer(p, np.uint8).astype(int)
        assert (r["media_bytes"], r["media_sha256"], r["media_type"]) == (len(stored), hashlib.sha256(stored).hexdigest(), media.STORED[check % 3])
        assert r["feature"] == f"declared={declared};confirmed={confirmed};corrected={int(confirmed != declared)};carved={media.STORED[check % 3]}@{start};rows={len(p) // 64};sum={s.sum()};squares={(s * s).sum()};levels={len(set(s.tolist()))}"
        seen.add((confirmed == declared, inside))
    assert len(seen) > 2


def test_media_in_containers_are_found():
    rng = np.random.default_rng(0)
    for n in range(len(media.BEFORE) + 1):
        for kind in media.STORED:
            for size in rng.integers(1, 40, 4):
                stored = media.store(bytes(rng.integers(0, 256, 64 * int(size), dtype=np.uint8)) if size % 2 else media.pad(b"; ! , BM RIFF " * int(size)), kind)
                assert media.sniff(media.BEFORE[:n] + stored + media.AFTER) == [media.Found(kind, n, len(stored))]


def test_png_filters():
    rng = np.random.default_rng(0)
    samples = rng.integers(0, 256, (10, 8)).astype(int)
    lines = []
    for y, row in enumerate(samples):
        up = samples[y - 1] if y else np.zeros(8, int)
        line = [y % 5]
        for x in range(8):
            a, b, c = (row[x - 1] if x else 0), up[x], (up[x - 1] if x else 0)
            paeth = min((a, b, c), key=lambda v: abs(a + b - c - v))
            line.append((row[x] - [0, a, b, (a + b) // 2, paeth][y % 5]) % 256)
        lines.append(line)
    assert media.unfiltered(np.array(lines, np.uint8)) == samples.astype(np.uint8).tobytes()


def test_jpeg_with_lone_markers_and_fill():
    head = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xff\xdb\x00\x03x\xff\x01\xff\xda\x00\x02data\xff\xd9"
    assert media.sniff(b"..." + head + b"...") == [media.Found("jpeg", 3, len(head))]


def test_media_odd(odd, none):
    rows = media.text_media(odd).collect()
    assert len(rows) == len(odd_rows()) and {r["payload_bytes"] for r in rows if r["doc_id"] in (0, 1)} == {64}
    assert media.text_media(none).count() == 0


# 10


def test_warc(spark):
    rows = [(5, "http://B.example.com/p?q=1", "same"), (3, "http://a.example.com/%41 b\n", "same"), (4, None, None), (9, "https://a.example.com/", ""), (7, "http://b.example.com/p?q=1", "é" * 1000), (5, "http://x", "same"), (None, "http://x", "same"), (8, "http://x", "only")]
    got = warc.captures(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    order = [(r["url_key"], r["captured_at"]) for r in got]
    assert order == sorted(order)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {"same": 3, "": 4, "é" * 1000: 7, "only": 8}
    want = [(i, len((h or "").encode()), digest(h), "response" if i == first[h or ""] else "revisit", None if i == first[h or ""] else first[h or ""], u) for i, u, h in rows]
    assert sorted(map(str, want)) == sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["url"])) for r in got)
    assert warc.captures(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_merges_many_runs_in_passes(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), f"http://h{rng.integers(0, 5)}.org/{rng.integers(0, 4)}", "x" * int(rng.integers(0, 5)), "own", 1) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, url_key string, run int").repartition(9)
    got = warc.merge_index(warc.read_archives(warc.write_archives(pages)), run_rows=3, fan=2).collect()
    order = [(r["url_key"], r["captured_at"], r["page_id"]) for r in got]
    assert order == sorted(order) and sorted(r["page_id"] for r in got) == list(range(200))
    first = {t: min(i for i, _, h, *_ in rows if h == t) for _, _, t, *_ in rows}
    assert all((r["page_id"] if r["refers_to"] is None else r["refers_to"]) == first["x" * r["payload_bytes"]] for r in got)


def test_warc_reads_blocks_about_once(spark):
    rng = np.random.default_rng(4)
    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, url_key string, captured_at string, run int, place long"
    rows = []
    for run in range(1000):
        for place, key in enumerate(sorted(rng.integers(0, 300, 40).tolist())):
            rows.append((run * 40 + place, 1, "d", "response", None, "u", f"k{key:04d}", "2020", run, place))
    entries = spark.createDataFrame(rows, kind).repartitionByRange(5, "run").sortWithinPartitions("run", "place")
    log = []
    got = warc.merge_index(entries, run_rows=4, fan=16, log=log).collect()
    keys = [(r["url_key"], r["captured_at"], r["page_id"]) for r in got]
    assert keys == sorted(keys) and sorted(k[2] for k in keys) == list(range(40_000))
    assert [p["runs"] for p in log] == [1000, 63, 4]
    assert all(p["reads"] < 2 * p["blocks"] for p in log) and all(p["rows"] == 40_000 for p in log)


def test_warc_odd(spark):
    long = "x" * 3_000_000
    rows = [(i, t, h, None, "clash", 7) for i, t, h in [(1, None, None), (1, None, None), (None, "http://a/", None), (2, "http://a/", ""), (3, "HTTP://A/é \n", long), (4, "http://a/", long), (4, "http://a/", long), (None, None, None)]]
    got = warc.captures(spark.createDataFrame(rows, "page_id long, url string, html string, url_key string, record_type string, run int").repartition(3)).collect()
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    low = {"": 1, long: 3}
    want = collections.Counter((i, len((h or "").encode()), digest(h), "response" if i == low[h or ""] else "revisit", None if i == low[h or ""] else low[h or ""]) for i, _, h, *_ in rows)
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want


def test_loser_tree():
    rng = np.random.default_rng(0)
    for k in (1, 2, 3, 7):
        runs = [sorted(rng.integers(0, 50, rng.integers(0, 30)).tolist()) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


# pipeline


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def test_near_copies_equal_brute_force(spark, docs):
    kept = {r["doc_id"] for r in near_copies.keep_one(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id").collect()}
    sets = [shingles(t) for t in docs.text]
    alike = lambda a, b: not a and not b or len(a & b) >= 0.8 * len(a | b)
    roots = brute_groups(sets, alike)
    assert kept == {int(docs.doc_id[r]) for r in set(roots)}


def kept_is_brute_force(spark, texts):
    """Rows that stay are those of an exact comparison of all pairs."""
    kept = {r["doc_id"] for r in near_copies.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id").collect()}
    sets = [shingles(t) for t in texts]
    alike = lambda a, b: not a and not b or len(a & b) >= 0.8 * len(a | b)
    assert kept == set(brute_groups(sets, alike))


def test_near_copies_of_large_families(spark):
    rng = np.random.default_rng(5)
    long = [f"longword{i}" for i in range(40)]
    body = [w for pair in zip(long * 3, [f"s{i}" for i in range(120)]) for w in pair]
    texts = []
    for family in range(2):  # long words tell the families apart, short ones the texts of one
        start = [*body]
        for at in (20, 100) if family else ():
            start[at] = f"family{at}"
        for i in range(12):
            text = [*start]
            text[-1 - 2 * (i % 3)] = f"e{i}"
            texts.append(" ".join(text))
    texts += [" ".join(rng.permutation(long * 6)) for _ in range(40)]  # the same words in another order
    texts += [texts[0] + " tail", " ".join(reversed(body))]
    kept_is_brute_force(spark, texts)


def test_near_copies_across_fifteen_long_words(spark):
    texts = []
    for i in range(30):
        text = [w for j in range(15) for w in (f"t{i}x{j}longer", f"a{i % 7}", f"b{j % 5}", f"c{i % 3}")]
        texts += [" ".join([*text, f"last{i}word"]), " ".join(text)]
    kept_is_brute_force(spark, texts)


@pytest.mark.parametrize("block", [512, 4])
def test_near_copies_with_block_edits(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = np.random.default_rng(7)
    texts = []
    for i in range(30):
        body = [f"t{i}common{k}" for k in rng.integers(0, 100, 1000)]
        texts += [" ".join(body), " ".join(body + [f"t{i}added{k}" for k in range((150, 200, 240, 249, 255)[i % 5])])]
    passage = [f"passage{k}" for k in range(300)]
    for i in range(20):  # much in common, but for a chain of them too little
        text = [*passage, *(f"o{i}own{k}" for k in range(100))]
        texts += [" ".join(text), " ".join([*text[:350], f"x{i}", *text[350:]]), " ".join([*text, *(f"y{i}end{k}" for k in range(90))])]
    kept_is_brute_force(spark, texts)


def test_near_copies_odd(odd, none):
    rows = near_copies.keep_one(odd).select("doc_id", "text").collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [0, 3, 6, 7, 8, 10, 11]
    assert near_copies.keep_one(none).count() == 0


def test_pipeline(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, SF)
        if name != "sequences":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.toPandas(), docs.schema)
    assert docs.count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() > 0


def test_near_duplicates_are_the_components_of_operator_three(spark, docs, odd):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, table, SF).select("doc_id").collect())
    assert kept == sorted({r["component_id"] for r in simhash.simhash_dedup(table).collect()}) and len(kept) < len(docs)
    rows = corpus_pipeline.near_duplicates(spark, odd, SF).collect()
    ids = [r["doc_id"] for r in rows]
    named = {r["component_id"] for r in simhash.simhash_dedup(odd).collect()}
    assert len(ids) == len(set(ids)) and set(ids) == named


def test_the_language_model_learns_from_no_sample(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(langmodel, "materialise", lambda df, label, put=langmodel.materialise: kept.append((label, put(df, label))) or kept[-1][1])
    docs = spark.createDataFrame([(i, f"some words {i % 7} of a text") for i in range(200)], "doc_id long, text string")
    assert langmodel.score(docs).count() == 200
    assert {label for label, _ in kept} == {"counts", "vocabulary", "blocks", "seen"}


def test_tokens_are_scored_in_the_same_few_arrays(monkeypatch):
    """A call takes any number of tokens, in bounded memory; rows are counted by the sums of their cells, not a second time."""
    texts = ["a b c a b", "b c d " * 50, "a b c d e", ""]
    model, hashes, place, seen, begun = small_model(texts)
    alone = np.zeros_like(seen)
    langmodel.gathered(hashes, place, 18, alone)
    assert (alone == seen).all() and (alone.reshape(-1, 64).sum(axis=1) == begun).all()
    context, leaf = langmodel.contexts(hashes, place), langmodel.leaf_of(hashes)
    want = np.concatenate([model.log_probability(context[:, t : t + 1], leaf[t : t + 1]) for t in range(len(leaf))])
    taken, exp = [], np.exp
    monkeypatch.setattr(langmodel, "BATCH", 64)
    monkeypatch.setattr(np, "exp", lambda v, **more: taken.append(len(v)) or exp(v, **more))
    got = model.log_probability(context, leaf)
    assert len(got) == len(leaf) > 128 and max(taken) == 64
    assert got == pytest.approx(want, abs=1e-5)
    assert len(model.log_probability(context[:, :0], leaf[:0])) == 0
