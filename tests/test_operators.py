"""Golden cases, ties and borders of the operators."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions import numbers, text
from quire.operators import blocks, claim, fixes, fonts, lines, ocr, profiles, reviews, styles
from quire.sources import files
from quire.streaming import profiles as stream


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def word(page=0, ln=0, pos=0, x=0.0, y=0.0, w=10.0, h=10.0, size=12.0, bold=False, text="a"):
    return dict(page=page, ln=ln, pos=pos, x=float(x), y=float(y), w=float(w), h=float(h), size=size, bold=bold, text=text)


WORD = "page long, ln int, pos int, x double, y double, w double, h double, size double, bold boolean, text string"


def words(spark, rows):
    return spark.createDataFrame(rows, WORD)


@pytest.mark.parametrize(("tag", "expected"), [("p", [1, 0, 1, 1, 1, 1]), ("img", [0, 0, 1, 1, 1, 0])])
def test_claim_thresholds(spark, tag, expected):
    w = words(spark, [word(page=i) for i in range(6)])
    b = spark.createDataFrame([(i, 0, tag, x, 0.0, 20.0, 10.0, 1) for i, x in enumerate([8.5, 8.6, 3.0, 3.1, 5.0, 5.1])], "page long, box int, tag string, x double, y double, w double, h double, reading_order int")
    got = {r["page"]: int(r["box"] is not None) for r in claim.claim(w, b).collect()}
    assert [got[i] for i in range(6)] == expected


def test_claim_tie_goes_to_the_earlier_box(spark):
    b = spark.createDataFrame([(0, 7, "p", 0.0, 0.0, 50.0, 50.0, 2), (0, 9, "p", 0.0, 0.0, 50.0, 50.0, 1)], "page long, box int, tag string, x double, y double, w double, h double, reading_order int")
    assert claim.claim(words(spark, [word(), word(page=1)]), b).select("page", "box").orderBy("page").collect() == [(0, 9), (1, None)]


@pytest.mark.parametrize(("xs", "margin"), [([50, 51, 10, 9], 52.0), ([2, 6, -2], 4.0)])
def test_left_margin(spark, xs, margin):
    assert lines.left_margin(words(spark, [word(pos=i, x=x) for i, x in enumerate(xs)])).first()["margin"] == margin


def test_line_grouping(spark):
    got = lines.anchor_lines(words(spark, [word(pos=i, y=y) for i, y in enumerate([0, 2, 4, 5])])).orderBy("pos").collect()
    assert [r["line"] for r in got] == [0, 0, 1, 1]
    got = lines.median_lines(words(spark, [word(pos=i, y=y) for i, y in enumerate([0, 4, 8, 12])])).orderBy("pos").collect()
    assert [r["line"] for r in got] == [0, 0, 1, 1]


def test_columns_and_nearest(spark):
    got = lines.columns([10, 12, 18, 26, 100, 104], 8)
    assert [round(x, 4) for x in got] == [13.3333, 26, 102]
    centres = F.array(F.lit(1.0), F.lit(3.0))
    assert one(spark, lines.nearest(F.lit(2.0), centres)) == 0
    assert one(spark, lines.nearest(F.lit(2.0), F.array().cast("array<double>"))) == 0


def test_segments_split_at_a_wide_gap_only(spark):
    xs = [0, 14, 28, 78]
    got = lines.segments(words(spark, [word(pos=i, x=x) for i, x in enumerate(xs)])).orderBy("pos").collect()
    assert [r["segment"] for r in got] == [0, 0, 0, 1]


def test_page_confidence(spark):
    b = spark.createDataFrame([(0, 0, 0, 10.0, 100.0, 60.0, 10.0, 10.0, 10), (0, 0, 1, 80.0, 101.0, 30.0, 10.0, 10.0, 5), (0, 1, 2, 10.0, 120.0, 48.0, 10.0, 10.0, 8)], "page long, line int, seq int, x double, y double, w double, h double, size double, length int")
    b = b.withColumn("indented", F.lit(False)).withColumn("text_indent", F.lit(0.0))
    pages = spark.createDataFrame([(0, 200.0, 200.0), (1, 200.0, 200.0), (2, 0.0, 1.0)], "page long, width double, height double")
    got = {r["page"]: r["confidence"] for r in lines.confidence(b, pages).collect()}
    assert got == {0: 0.8121, 1: 0.0, 2: 0.0}


def test_ocr_scores(spark):
    box = lambda *v: tuple(F.lit(float(x)) for x in v)
    assert one(spark, g.iou(box(0, 0, 10, 10), box(5, 0, 10, 10))) == pytest.approx(1 / 3)
    assert one(spark, g.position_score(box(0, 0, 10, 10), box(5, 0, 10, 10))) == pytest.approx(0.56)
    assert one(spark, text.text_score(F.lit("a b c"), F.lit("b c d"))) == 0.5
    assert one(spark, text.text_score(F.lit(""), F.lit(""))) == 1.0
    assert one(spark, text.text_score(F.lit("ab"), F.lit("xaby"))) == 0.82


def test_rotation(spark):
    turn = lambda x, y: one(spark, g.rotation(F.lit(float(x)), F.lit(float(y))))
    assert turn(0, -10) == -90 and turn(0.2, 10) == 90 and turn(0.001, 0) == 0 and turn(-10, -0.001) == 180


def test_tsv_and_lines(spark):
    raw = ["level\tpage_num\tb\tp\tl\tw\tx\ty\tw\th\tconf\ttext", "5\t1\t1\t1\t1\t1\t10\t20\t30\t10\t90.5\tHello", "5\t1\t1\t1\t1\t2\t50\t21\t30\tx\t80\ta\tb", "4\t1\t1\t1\t1\t0\t0\t0\t0\t0\t-1\t", "short"]
    rows = ocr.parse_tsv(spark.createDataFrame([(x,) for x in raw], "value string"))
    assert [r["text"] for r in rows.orderBy("word").collect()] == ["Hello", "a\tb"]
    line = ocr.build_lines(rows).first()
    assert (line["x"], line["y"], line["w"], line["confidence"], line["text"]) == (10, 20, 70, 85.25, "Hello a\tb")


def test_text_normalisation(spark):
    norm = lambda x: one(spark, text.normalise(F.lit(x)))
    assert norm("é") == "é"
    assert norm("ﬁn ﬃ") == "fin ffi"
    assert norm("itâ€™s") == "it’s"
    assert norm("Ã©tÃ©") == "été"
    assert norm("a\u0007b️   c") == "ab c"
    assert norm("A B C D") == "ABCD" and norm("A B") == "A B"
    # a later rule never sees its whole source, as earlier ones have taken its end
    double = next(s for s, t in text.MOJIBAKE[15:] if t == "–")
    assert norm(double) != "–"
    kinds = {w["type"]: w["count"] for w in one(spark, text.warning_counts(F.lit("�\u0001️Ã")))}
    assert kinds == dict.fromkeys(text.WARNINGS, 1)
    log = one(spark, text.replacement_log(F.lit("ﬁﬁ\u0001\u0002")))
    assert [r["reason"] for r in log] == ["ligature", "control", "control"]
    assert one(spark, text.decode_entities(F.lit("&#x41;&#66;&amp;lt;&#xD800;"))) == "AB<&#xD800;"
    assert one(spark, text.units(F.lit("a\U0001f600"))) == 3


def test_css(spark):
    got = one(spark, text.css_declarations(F.lit("Top: 1px; left:2px; top:3px; bad; u: a:b")))
    assert [(x["key"], x["value"]) for x in got] == [("top", "3px"), ("left", "2px"), ("u", "a:b")]


@pytest.mark.parametrize(("value", "places", "expected"), [(0.125, 2, 0.13), (-0.125, 2, -0.13), (2.5, 0, 3.0), (0.0, 3, 0.0)])
def test_fixed(spark, value, places, expected):
    assert one(spark, numbers.fixed(F.lit(value), places)) == expected


def fix(kind, **v):
    return profiles.Fix(kind, *(v.get(f) for f in profiles.Fix._fields[1:]))


def learned(*fixes):
    state = profiles.START
    for x in fixes:
        state = profiles.learn(state, x)
    return dict(zip(profiles.FIELDS, state))


def test_profile_steps():
    p = learned(fix("move", dx=10.0, dy=4.0))
    assert (p["offset_x"], p["offset_y"], p["drift"]) == (1.5, 0.6, 0.6)
    assert learned(fix("move", dx=2.0, dy=-2.0))["offset_x"] == 0
    assert learned(fix("merge"))["x_gap"] == 12.3 and learned(fix("merge"), fix("split"))["x_gap"] == 12.0
    assert learned(fix("tag-change", tag="h1", size=20.0))["h1"] == 18.3
    assert learned(fix("resize"))["samples"] == 1
    assert profiles.encoding_rules([("abc", "axc"), ("b", "y")]) == {"b": "y"}


def test_fold_equals_stream(spark, tmp_path):
    kinds = ["move", "delete", "tag-change", "merge", "split"]
    rows = [dict(fingerprint=f"f{i % 3}", ts=f"2024-01-01T00:00:{i:02d}Z", seq=i, type=kinds[i % 5], dx=float(i % 7), dy=float(i % 5 - 2), tag="h2", size=10.0 + i % 9, indented=bool(i % 2), x=20.0, margin=4.0, prev_dy=float(i % 6), text_indent=None) for i in range(60)]
    schema = "fingerprint string, ts string, seq long, type string, dx double, dy double, tag string, size double, indented boolean, x double, margin double, prev_dy double, text_indent double"
    batch = profiles.fold(spark.createDataFrame([tuple(r.values()) for r in rows], schema))
    want = {r["fingerprint"]: tuple(r)[1:-1] for r in batch.collect()}
    for at in (0, 30):
        (tmp_path / f"{at}.json").write_text("\n".join(json.dumps(r) for r in rows[at : at + 30]))
        os.utime(tmp_path / f"{at}.json", (1e9 + at, 1e9 + at))  # files are taken by age
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    run = stream.learned(source).writeStream.outputMode("update").format("memory").queryName("learned").start()
    run.processAllAvailable()
    run.stop()
    got = {r["fingerprint"]: tuple(r)[1:] for r in stream.latest(spark.table("learned")).collect()}
    assert got == want and set(want) == {"f0", "f1", "f2"}


def test_stream_learns_late_fixes_in_order(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = ["move", "resize", "merge", "split", "tag-change", "delete", "text-correct", "style-change", "create-group"]
    schema = "fingerprint string, ts timestamp, seq long, type string, dx double, dy double, tag string, size double, indented boolean, x double, margin double, prev_dy double, text_indent double, before string, after string"
    names = [f.split(" ")[0] for f in schema.split(", ")]
    rows = [(f"f{i % 2}", f"2024-01-01T00:{i // 2:02d}:00Z", i, kinds[i % 9], float(i % 7), float(i % 5 - 2), ["h2", "artifact", "p"][i % 3], 10.0 + i % 9, i % 4 == 1, 20.0, 4.0, float(i % 6), [None, 3.0][i % 2], f"a{i % 3}é", f"b{i % 4}é{i}") for i in range(72)]
    write = lambda at, part: ((tmp_path / f"{at}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in part)), os.utime(tmp_path / f"{at}.json", (1e9 + at, 1e9 + at)))
    write(0, rows[1::2][::-1])  # each file holds what the other lacks, out of order
    write(1, rows[0::2])
    write(2, [("end", "2024-01-02T00:00:00Z", 999, "delete", *[None] * 11)])
    write(3, [("end", "2024-01-03T00:00:00Z", 1000, "delete", *[None] * 11)])
    batch = profiles.fold(spark.read.schema(schema).json([str(tmp_path / f"{i}.json") for i in range(2)]))
    want = {r["fingerprint"]: tuple(r)[1:] for r in batch.collect()}
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    run = stream.learned_in_order(source, "2 hours").writeStream.outputMode("update").format("memory").queryName("ordered").start()
    run.processAllAvailable()
    run.stop()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r["fingerprint"]: tuple(r)[1:] for r in stream.latest(spark.table("ordered")).collect()}
    assert got["f0"] == want["f0"] and got["f1"] == want["f1"] and want["f0"][-1] and want["f0"][0] == 36


def test_span_merge(spark):
    rows = [(0, 0, 0.0, 0.0, 0.0, 20.0, 10.0, "Hello", 10.0, "f", 0.0), (0, 1, 0.0, 25.0, 0.0, 20.0, 10.0, "there", 10.0, "f", 0.0), (0, 2, 0.0, 80.0, 0.0, 20.0, 10.0, "far", 10.0, "f", 0.0), (0, 3, 0.0, 0.0, 30.0, 20.0, 10.0, "next", 10.0, "g", 0.0)]
    spans = spark.createDataFrame(rows, "page long, seq long, margin double, x double, y double, w double, h double, text string, size double, font string, rotation double")
    got = blocks.merge_spans(spans).orderBy("y", "x").collect()
    assert [(r["text"], r["spans"]) for r in got] == [("Hello there", 2), ("far", 1), ("next", 1)]


def test_fix_application(spark):
    names = ["page", "seq", "id", "suppressed", *fixes.FIELDS]
    kinds = ", ".join(f"{f} {k}" for f, k in fixes.FIELDS.items())

    def block(page, seq, id_, suppressed=False, **v):
        given = dict(x=0.0, y=10.0 * seq, w=9.0, h=9.0, text=id_, tag="p", size=11.0, font="F", color="#1", indented=True) | v
        return tuple({"page": page, "seq": seq, "id": id_, "suppressed": suppressed}.get(n, given.get(n)) for n in names)

    def change(page, seq, kind, id_, second=None, **v):
        return (page, seq, kind, id_, second, *(v.get(f) for f in fixes.FIELDS))

    held = [block(0, i, f"b{i}") for i in range(5)] + [block(0, 5, "cut", suppressed=True, text="cut"), block(0, 6, "crop", tag="img", crop_x=0.0, crop_y=60.0, crop_w=9.0, crop_h=9.0), block(2, 0, "only")]
    log = [
        change(0, 1, "delete", "b0"), change(0, 2, "merge", "b1", "b2", text="b1 b2", size=20.0), change(0, 3, "tag-change", "b3", tag="h1"), change(0, 4, "move", "gone", x=5.0), change(0, 5, "merge", "new", "b4", text="first's place"),
        change(0, 6, "resize", "crop", w=20.0), change(0, 7, "merge", "cut", "cut", text="again"), change(0, 8, "style-change", "b3", text_indent=4.0), change(0, 9, "merge", "b9", text=" "),
        change(1, 5, "create-group", "g", x=1.0, y=1.0, w=5.0, h=5.0, text="new"), change(1, 6, "create-group", "i", tag="img"), change(1, 7, "split", "g", w=0.5), change(2, 1, "delete", "only"), change(2, 2, "text-correct", "only", text="late"),
    ]
    b = spark.createDataFrame(held, f"page long, seq long, id string, suppressed boolean, {kinds}")
    f = spark.createDataFrame(log, f"page long, seq long, type string, block string, second string, {kinds}").repartition(3)
    got = {(r["page"], r["id"]): r.asDict() for r in fixes.applied(b, f).collect()}
    # a merge without a text has none and goes; a group is made of its fix alone
    assert set(got) == {(0, "b1"), (0, "b3"), (0, "new"), (0, "crop"), (0, "cut"), (1, "i")}
    one_ = got[0, "b1"]
    assert (one_["text"], one_["tag"], one_["size"], one_["font"], one_["color"], one_["confidence"], one_["indented"], one_["y"], one_["line_height"]) == ("b1 b2", "p", 20.0, "serif", "#000000", 0.8, False, 10.0, 1.4)
    assert (got[0, "new"]["y"], got[0, "new"]["w"]) == (0.0, 9.0)  # from the page's first block, though that was deleted
    assert (got[0, "b3"]["tag"], got[0, "b3"]["text_indent"], got[0, "b3"]["font"]) == ("h1", 4.0, "F")
    assert [got[0, "crop"][f"crop_{c}"] for c in "xywh"] == [0.0, 60.0, 20.0, 9.0]
    assert (got[0, "cut"]["text"], got[0, "cut"]["y"]) == ("again", 50.0)


def test_indent_guard_looks_at_the_whole_block(spark):
    span = lambda seq, x, y, text: (None, seq, 0.0, x, y, 20.0, 10.0, text, 10.0, "f", 0.0)
    rows = [span(0, 20.0, 0.0, "a"), span(1, 42.0, 0.0, " b\tc "), span(2, 64.0, 1.0, "d"), span(3, 90.0, 1.0, None), span(4, 90.0, 1.0, "  ")]
    spans = spark.createDataFrame(rows, "page long, seq long, margin double, x double, y double, w double, h double, text string, size double, font string, rotation double")
    got = blocks.merge_spans(spans).orderBy("x").collect()
    assert [(r["page"], r["text"], r["spans"]) for r in got] == [(None, "ab c", 2), (None, "d", 1)]


def test_training_needs_rows_and_learns(spark):
    rows = [(i, "merge" if i % 2 else "split", 10.0 + i % 2 * 8) for i in range(60)]
    fixes = spark.createDataFrame(rows, "seq long, type string, size double").selectExpr("*", "'' tag", "'normal' weight", "'F' font", "0D x", "0D y", "1D w", "1D h", "'a b' text", "false indented", "0D text_indent", "0D padding_left")
    made = reviews.features(fixes)
    learned = reviews.train(made, "join")
    assert learned["accuracy"] == 1.0 and max(learned["importances"], key=learned["importances"].get) == "size"
    assert reviews.train(made, "tag") is None


def test_style_ids_are_stable(spark):
    first = spark.createDataFrame([("p", "b", 2), ("p", "a", 1), ("q", "a", 3)], "prefix string, css string, seq int")
    ids = styles.style_ids(first)
    assert {(r["prefix"], r["css"]): r["id"] for r in ids.collect()} == {("p", "a"): 1, ("p", "b"): 2, ("q", "a"): 1}
    more = styles.style_ids(spark.createDataFrame([("p", "c", 1), ("p", "a", 2)], "prefix string, css string, seq int"), ids)
    assert {(r["prefix"], r["css"]): r["id"] for r in more.collect()} == {("p", "a"): 1, ("p", "b"): 2, ("p", "c"): 3, ("q", "a"): 1}


def test_fonts(spark):
    f = spark.createDataFrame([(1, "ABCDEF+Noto Sans-Bold", "Noto Sans"), (2, "Serif", "Serif")], "seq int, base_font string, family string")
    names = spark.createDataFrame([("XYZABC+NotoSans",), ("Noto",), ("Courier",)], "name string")
    assert {r["name"]: r["family"] for r in fonts.resolve(names, f).collect()} == {"XYZABC+NotoSans": "Noto Sans", "Noto": "Noto Sans", "Courier": "Courier"}


def test_training_status():
    assert reviews.training_status(0) == {"should_train": False, "next_at": 50}
    assert reviews.training_status(50)["should_train"] and not reviews.training_status(50, running=True)["should_train"]
    assert reviews.training_status(51)["next_at"] == 100


def test_files(spark, tmp_path):
    (tmp_path / "a/visits").mkdir(parents=True)
    (tmp_path / "a/1.json").write_text('{"id": "x", "timestamp": "2"}')
    (tmp_path / "a/2.json").write_text("{broken")
    (tmp_path / "a/visits/3.json").write_text('{"id": "v", "visitedAt": "1"}')
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    assert [r["id"] for r in files.fix_log(spark, str(tmp_path), "id string, timestamp string").collect()] == ["x"]
    assert [r["id"] for r in files.visit_log(spark, str(tmp_path), "id string, visitedAt string").collect()] == ["v"]
    assert [r["is_pdf"] for r in files.pdf_files(spark, str(tmp_path / "a.pdf")).collect()] == [True]
    import io
    import zipfile

    z = zipfile.ZipFile(io.BytesIO(files.stored_zip([("b", b"2"), ("a", b"1")], {"b": b"3"})))
    assert z.namelist() == ["a", "b"] and z.read("b") == b"3" and z.testzip() is None
    assert files.under(str(tmp_path / "a"), [str(tmp_path)]) and not files.under(str(tmp_path) + "x", [str(tmp_path)])
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, n int, v string")
    assert files.latest(log, ["k"], "n").first()["v"] == "y"
    assert math.isclose(one(spark, g.scale_for(F.lit(300.0))), 150 / 72)


def test_reviewers_drafts_and_patches(spark):
    log = "job long, page long, reviewer string, ts string, seq long"
    f = spark.createDataFrame([(1, 0, "a", "1", 1), (1, 1, "a", "2", 2), (1, 1, None, "3", 3)], log)
    v = spark.createDataFrame([(1, 0, "b", "4", 4), (2, 0, None, "5", 5)], log)
    got = {r["job"]: (r["edits"], r["reviewed"], r["edited"], r["accurate"], r["reviewers"], r["last_edit"]) for r in reviews.summary(f, v).collect()}
    assert got == {1: (3, 1, 2, 0, 2, "3"), 2: (0, 1, 0, 1, 0, None)}
    jobs = spark.createDataFrame([(10, "done", "x", 1), (20, "done", "x", 3)], "id long, status string, updated string, job long")
    listed = reviews.job_list(jobs, f, v, spark.createDataFrame([(1, 5), (1, 2), (1, 5)], "job long, page long"))
    assert {r["id"]: r["draft_pages"] for r in listed.collect()} == {10: [2, 5], 20: []}
    now = spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], "id long, name string, updatedAt string")
    got = files.patched(now, spark.createDataFrame([(1, None, "mine")], "id long, name string, updatedAt string"), ["id"], F.lit("now")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a", "now"), (2, "b", "old")]
    rows = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, None, "b"), (4, "k", None), (5, "k", None)], "seq long, key string, id string")
    assert sorted(r["seq"] for r in styles.upsert(rows).collect()) == [2, 3, 5]


def test_regions_move_by_one(spark):
    boxes = spark.createDataFrame([(p, f"b{i}", float(i), i) for p in range(3) for i in range(3)], "page long, box string, reading_order double, created_at int")
    moves = spark.createDataFrame([(0, "b0", 1), (1, "b0", -1)], "page long, box string, step int")
    got = {p: [r["box"] for r in sorted(rows, key=lambda r: r["reading_order"])] for p in range(3) for rows in [[r for r in claim.moved(boxes, moves, ["page"]).collect() if r["page"] == p]]}
    assert got == {0: ["b1", "b0", "b2"], 1: ["b0", "b1", "b2"], 2: ["b0", "b1", "b2"]}


def test_read_lines_in_order(spark):
    rows = spark.createDataFrame([(0, 50.0, 10.0, 90.0), (0, 10.0, 11.5, 80.0), (0, 0.0, 13.0, 70.0)], "page long, x double, y double, confidence double")
    assert [r["x"] for r in ocr.in_order(rows).orderBy("seq").collect()] == [10.0, 50.0, 0.0]
    assert ocr.page_confidence(rows).first()["confidence"] == 80.0


def test_matching_equals_all_pairs(spark):
    import random

    rng = random.Random(1)
    texts = ["a b c", "a b", "c", "", "d e f g", "x", "a b c d", "zz a b"]
    block = [(p, i, float(rng.randrange(0, 200)), float(rng.randrange(0, 400)), float(rng.choice([5, 40, 300])), float(rng.choice([8, 10, 60])), rng.choice(texts), 12.0) for p in range(6) for i in range(25)]
    read = [(p, i, float(rng.randrange(0, 200)), float(rng.randrange(0, 400)), float(rng.choice([5, 40, 300])), float(rng.choice([8, 10, 60])), rng.choice(texts)) for p in range(5) for i in range(20)]
    b = spark.createDataFrame(block, "page long, ln long, x double, y double, w double, h double, text string, size double")
    o = spark.createDataFrame(read, "page long, seq long, x double, y double, w double, h double, text string")
    pairs = b.selectExpr("page", "ln", "x bx", "y by", "w bw", "h bh", "text bt").join(o, "page").withColumn("score", 0.55 * g.position_score(g.box("b"), g.box()) + 0.45 * text.text_score(F.col("bt"), F.col("text"))).collect()
    want = {}
    for r in sorted(pairs, key=lambda r: (-r["score"], r["seq"])):
        if r["score"] > 0:
            want.setdefault((r["page"], r["ln"]), (r["seq"], round(r["score"], 9)))
    for reach in (24.0, 5.0, 1000.0):
        got = {(r["page"], r["ln"]): (r["seq"], r["score"] and round(r["score"], 9)) for r in ocr.match(b, o, reach).collect()}
        assert len(got) == len(block) and {k: v for k, v in got.items() if v[0] is not None} == want
