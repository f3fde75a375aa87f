"""Chat formatting, the filter audit and vector codes against brute force, and on odd inputs."""

import collections
import hashlib
from itertools import permutations

import numpy as np
import pytest

from quire.llm import chat, filter_audit, queries, vector_codes

from ..conftest import SF

# 11


SIGNS = ["[INST]", "[/INST]", "</s>", "<s>", "[\\INST]", "[\\\\IMG]", "[IMG]", "[", "]", "<", "\\", "/s>", " ", "\n", "a", "ß\U0001f600", "![x](y.png)", "![](b.PDF)", "![", "[ROLE]", "[/TURN]", "[DOC]"]


def random_text(rng):
    return "".join(rng.choice(SIGNS, rng.integers(0, 14)))


def test_escapes_are_reversible_and_leave_no_control_string():
    codec, rng = chat.Codec(chat.Template()), np.random.default_rng(0)
    for _ in range(3000):
        text = random_text(rng)
        plain = codec.escape(text)
        assert codec.restore(plain) == text
        assert not any(c in plain for c in codec.template.controls)


def test_ambiguous_templates_are_refused():
    with pytest.raises(ValueError):
        chat.Template(pad="[")
    with pytest.raises(ValueError):
        chat.Template(close="[a[b]")


def brute_chats(rows):
    """Digest by conversation of rows (conv, turn, role, text)."""
    held = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        held[conv].append((turn is not None, turn or 0, role is not None, role or "", text or ""))
    out = {}
    for conv, turns in held.items():
        turns.sort(key=lambda t: t[:4])
        loss = "".join(t[4] for t in turns if t[3] == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{t[3]}\n{t[4]}\n" for t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def read(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows}


def test_chats_come_back(spark):
    rng = np.random.default_rng(1)
    rows = [(int(c), t, str(rng.choice(["system", "user", "assistant", "tool [INST]", ""])), random_text(rng)) for c in range(60) for t in range(int(rng.integers(1, 9)))]
    rows += [(100, t, ["user", "assistant"][t % 2], random_text(rng)) for t in range(1500)]  # half of all rows, over all tasks
    rows += [(None, 0, None, None), (None, None, "assistant", ""), (7000, None, "assistant", "x"), (7001, 0, "assistant", "long " * 300_000), (7001, 1, "user", None)]
    rows += [(7002, 3, "user", "again")] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "text AS formatted", "1 AS mark", "2 AS seq", "role AS content").repartition(5)
    for limit in (chat.CHUNK, 500):
        chunks = chat.format_chats(df, chunk=limit).cache()
        assert read(chat.read_back(chunks)) == brute_chats(rows)
        assert chunks.where("conv_id = 100").count() > 1 and chunks.where("n_turns = 0").count() == 0
        assert chunks.where(f"n_turns > 1 AND length(formatted) > {limit} + 2000").count() == 0
        chunks.unpersist()


def test_no_chats(spark):
    assert chat.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


LEAF = "type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int"


def test_parts_become_placeholders(spark):
    def leaf(**k):
        return {c: k.get(c) for c in ("type", "text", "ref", "width", "height", "seconds", "pages")}

    turn = [
        leaf(type="text", text="see [IMG] "), leaf(type="image", ref="a", width=57, height=28) | {"parts": None}, leaf(type="audio", ref="b", seconds=1.5),
        leaf(type="document", ref="c", pages=2) | {"parts": [leaf(type="text", text="inside "), leaf(type="image", ref="d")]}, leaf(type="other", text="!"), None,
    ]
    turn = [p and {"parts": None} | p for p in turn]
    df = spark.createDataFrame([(1, 0, "user", turn), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<struct<{LEAF}, parts: array<struct<{LEAF}>>>>")
    chunks = chat.format_chats(df, content_col="parts").collect()
    assert "".join(c["formatted"] for c in chunks) == "[INST] see [\\IMG] [IMG][AUDIO][DOC]inside [IMG][/DOC]! [/INST]<s>  </s>"
    assert [(a["kind"], a["ref"], a["tokens"]) for c in chunks for a in c["attachments"]] == [("image", "a", 3), ("audio", "b", 38), ("document", "c", 1024), ("image", "d", 256)]
    got = chat.read_back(chat.format_chats(df, content_col="parts")).collect()
    assert [(r["n_turns"], r["attached_tokens"], r["n_attachments"]) for r in got] == [(2, 1321, 4)]
    assert got[0]["turns_sha256"] == hashlib.sha256(b"user\nsee [IMG] inside !\nassistant\n\n").hexdigest()


def test_links_are_attachments_in_their_own_words(spark):
    text = "a ![one](p/x.png) ![](s.MP3)![d](t.pdf) ![no](z.txt) ![[x](q.png) " + "![" * 5000
    df = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")
    row = chat.conversations(df).collect()[0]
    assert (row["n_attachments"], row["attached_tokens"], row["loss_chars"]) == (3, 256 + 750 + 512, len(text))
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


# 12


def test_walk_visits_each_order_by_one_swap():
    for n in range(1, 6):
        seen = list(filter_audit.walk(n))
        assert sorted(tuple(o) for o, _ in seen) == sorted(permutations(range(n)))
        for (a, _), (b, at) in zip(seen, seen[1:]):
            want = list(a)
            want[at], want[at + 1] = want[at + 1], want[at]
            assert b == want
    assert filter_audit.orders("AB") == ["AB", "BA"]


def brute_audit(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    import re

    low = {}
    for i, t, _ in rows:
        if i is not None:
            low[t or ""] = min(i, low.get(t or "", i))
    good, bad = {l[0] for l in labels if l[1] == 1 and l[0] is not None}, {l[0] for l in labels if l[2] == 1 and l[0] is not None}
    parts = collections.defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {c for c, f in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search(r"[#$%&*|]", t), i is not None and low[t] < i)) if f}
        parts[lang or ""].append((fails, i in good, i in bad))
    out = {}
    for part, docs in parts.items():
        total = collections.Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, c in enumerate(order):
                gone = [d for d in left if c in d[0]]
                left = [d for d in left if c not in d[0]]
                total[c] += len(gone)
                out[part, "".join(order), step + 1] = [c, len(left), len(gone), sum(c in d[0] for d in docs) - len(gone), sum(d[0] == {c} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for key in out:
            if key[0] == part:
                out[key].append(total[out[key][0]])
    return out


def audited(spark, rows, labels):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "text AS part", "1 AS mask", "2 AS n", "3 AS good", "lang AS _text").repartition(3)
    got = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    out = {(r["part"], r["filter_order"], r["step"]): [r["filter"], *[r[c] for c in filter_audit.COUNTS], r["shapley"]] for r in got}
    assert len(out) == len(got)
    return out


def test_audit_is_brute_force(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)] + ["UPPER", "#", "X*Y"]
    texts = [" ".join(rng.choice(words[: int(rng.choice([30, 303]))], int(rng.integers(80, 300)))) for _ in range(60)] + [None, "", " \n", "x" * 100_000, "AAA " * 200, "ä b\x1cc " * 60]
    rows = [(int(i), texts[int(rng.integers(0, len(texts)))], [None, "", "en", "fr"][int(rng.integers(0, 4))]) for i in rng.permutation(400)]
    rows += [(900 + i, texts[0], "en") for i in range(300)]  # a third are copies of one text
    rows += [rows[0], rows[0], (rows[1][0], rows[1][1], "fr"), (None, texts[0], "en"), (None, texts[0], "en"), (None, None, None), (None, "only here", "fr"), (-5, texts[0], "de"), (-5, texts[0], "fr"), (-5, texts[0], "fr")]
    labels = [(int(i), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in rng.choice(700, 300)] + [(None, 1, 1), (3, None, None), (4, None, 1), (-5, 1, None)]
    assert audited(spark, rows, labels) == brute_audit(rows, labels)
    assert audited(spark, rows[:50], []) == brute_audit(rows[:50], [])
    assert audited(spark, [], labels) == {}


# 13


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, vector, label), all of one length and whole; by position."""
    q = np.floor(256 * np.array([r[1] for r in rows], np.float64)).astype(np.int64)
    width = q.shape[1] // parts
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, q[i].tolist()))
    x = q.reshape(len(rows), parts, width)
    books = x[order[:entries]].transpose(1, 0, 2).copy()

    def assign():
        return np.array([[int(((x[i, p] - books[p]) ** 2).sum(axis=1).argmin()) for p in range(parts)] for i in range(len(rows))])

    for _ in range(rounds):
        code = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                held = x[code[:, p] == e, p]
                if len(held):
                    books[p, e] = [int(s) // len(held) for s in held.sum(axis=0)]
    code = assign()
    error = [int(sum(((x[i, p] - books[p, code[i, p]]) ** 2).sum() for p in range(parts))) for i in range(len(rows))]
    by = collections.Counter()
    for r, e in zip(rows, error):
        by[r[2]] += e
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return collections.Counter((r[0], "".join(f"{c:02x}" for c in code[i]), error[i], by[r[2]], digest) for i, r in enumerate(rows))


VECTORS = "vec_id long, embedding array<float>, label int"


def coded(spark, rows, **k):
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "label AS q", "label AS code", "1 AS error", "2 AS `key`").repartition(3)
    return collections.Counter(tuple(r) for r in vector_codes.encode(df, **k).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def test_codes_are_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(0, 0.3, 64).astype(np.float32).tolist(), [None, 1, 2][i % 3]) for i in rng.permutation(400)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(200)]  # a third are one vector
    # few values: many ties
    coarse = [(int(i), (rng.integers(-2, 3, 64) / 256).tolist(), 5) for i in range(300)]
    for table in (rows, coarse, rows[:7], [(1, [0.5] * 64, None)] * 3, [*rows[:80], (None, rows[3][1], 9), (rows[4][0], rows[5][1], 9), (rows[4][0], rows[5][1], 9)]):
        want = brute_codes(table)
        odd = [(5, None, 1), (6, [], 1), (7, [0.1] * 63 + [None], 1), (8, [0.1] * 63 + [float("nan")], 1), (9, [float("inf")] * 64, 2), (-9, [0.1] * 32, 2), (-8, [0.1] * 5, 2)]
        assert coded(spark, table + odd[: 5 if len(table) < 4 else 7]) == want
    assert coded(spark, []) == collections.Counter()
    assert coded(spark, [(5, None, 1), (6, [], None)]) == collections.Counter()
    with pytest.raises(ValueError):
        coded(spark, [(1, [1e30] * 64, 0)])


def test_other_shapes(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1, 12).tolist(), 0) for i in range(90)]
    rows = [(i, np.array(v, np.float32).tolist(), c) for i, v, c in rows]
    got = coded(spark, rows, parts=3, entries=8, rounds=4)
    assert got == brute_codes(rows, 3, 8, 4)


def test_bounds_hold_and_prune(spark):
    rng = np.random.default_rng(5)
    near = rng.normal(0, 1, (40, 64))
    rows = [(i, (near[i % 40] + rng.normal(0, 0.02, 64)).astype(np.float32).tolist(), 0) for i in range(2000)]
    bounds, books = vector_codes.train(spark.createDataFrame(rows, VECTORS))
    got = bounds.collect()
    assert sum(r["tried"] for r in got) < 0.2 * 2000 * 16 * 64
    for r in got[:300]:
        x = np.frombuffer(r["q"], "<i4").reshape(16, 4).astype(np.int64)
        code, upper, lower = np.frombuffer(r["code"], "u2"), np.frombuffer(r["upper"], "<f4"), vector_codes.LEVELS[np.frombuffer(r["lower"], "u1")].reshape(16, 64)
        far = np.array([books.distances(p, x[None, p])[0] for p in range(16)])
        assert (far.argmin(axis=1) == code).all()
        assert (np.sqrt(far) >= lower).all() and (np.sqrt(far[np.arange(16), code]) <= upper).all()


def test_bounds_are_not_left_behind(spark):
    from quire.llm.common import list_shared, shared_dir

    df = spark.createDataFrame([(i, [i / 300.0] * 16, 0) for i in range(200)], VECTORS)
    before = {f for f in list_shared(shared_dir(spark), ".parquet") if "-bounds/" in f}
    assert vector_codes.encode(df).count() == 200
    assert {f for f in list_shared(shared_dir(spark), ".parquet") if "-bounds/" in f} <= before


@pytest.mark.parametrize("name", ["op11_chat", "op12_filter_audit", "op13_vector_codes"])
def test_queries_equal_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    place = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted(got.columns) == columns
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in place)) for r in want.fetchall())
