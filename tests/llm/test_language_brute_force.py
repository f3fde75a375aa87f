"""Language ID of whole tables against plain loops: every text, host, suffix and declared language counted by hand."""

import collections
import html
import math
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from quire.llm import langid, queries

from ..conftest import SF


def grams(text):
    b = b" " + text.lower().encode() + b" "
    return [((x << 16 | y << 8 | z) * 2654435761 % (1 << 32)) >> 16 for x, y, z in zip(b, b[1:], b[2:])]


def brute(docs, pages):
    """(text, label) rows and (id, url, html) rows to id: language, posterior, accepted."""
    labels = sorted({label for text, label in docs if text and label is not None})
    n = len(labels)
    seen = {label: collections.Counter() for label in labels}
    rows = collections.Counter()
    for text, label in docs:
        if text and label is not None:
            rows[label] += 1
            seen[label].update(grams(text))
    whole = {label: sum(seen[label].values()) + 0.5 * (1 << 16) for label in labels}
    prior = [math.log((rows[label] + 1) / (sum(rows.values()) + n)) for label in labels]
    judged = []
    for key, url, page in pages:
        page = page or ""
        declared = re.search(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", page)
        text = html.unescape(re.sub(r"(?s)<[^>]*>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", page)))
        counted = collections.Counter(grams(text))
        score = [sum(c * float(np.float32(math.log((seen[label][g] + 0.5) / whole[label]))) for g, c in counted.items()) / 3 for label in labels]
        z = [s + p for s, p in zip(score, prior)]
        own = [math.exp(v - max(z)) for v in z]
        own = [v / sum(own) for v in own]
        host = re.match(r"^[a-z][a-z0-9+.-]*://([^/:?#]*)", (url or "").lower())
        host = host[1] if host else ""
        judged.append((key, score, own, host, host.rsplit(".", 1)[-1], declared[1].lower() if declared else "", any(map(str.isalpha, text))))
    sums = collections.defaultdict(lambda: [0.0] * n)
    sizes = collections.Counter()
    for _, _, own, host, suffix, said, _ in judged:
        for key in (("host", host), ("suffix", suffix), ("said", said), ("all", "")):
            sums[key] = [a + b for a, b in zip(sums[key], own)]
            sizes[key] += 1
    total = sums["all", ""]
    base = [(v + 1) / (sum(total) + n) for v in total]
    out = {}
    for key, score, own, host, suffix, said, letters in judged:
        wide = [(s + 10 * b) / (sizes["suffix", suffix] + 10) for s, b in zip(sums["suffix", suffix], base)]
        fit = [(s + 0.1) / (t + 6.4) for s, t in zip(sums["said", said], total)]
        own_host = [(max(s - o, 0.0) + 10 * w) / (sizes["host", host] - 1 + 10) for s, o, w in zip(sums["host", host], own, wide)]
        log = [s + math.log(f) + math.log(h) for s, f, h in zip(score, fit, own_host)]
        posterior = 1 / sum(math.exp(v - max(log)) for v in log)
        out[key] = (labels[log.index(max(log))], posterior, letters and posterior >= 0.5)
    return out


def test_op8_is_brute_force(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    pages = pq.read_table(f"{SF}/pages.parquet").to_pandas()
    want = brute(list(zip(docs.text, docs.lang)), list(zip(pages.page_id, pages.url, pages.html)))
    got = {r["page_id"]: r for r in queries.op8_language_id(spark, SF).collect()}
    assert set(got) == set(want)
    for key, (language, posterior, accepted) in want.items():
        assert got[key]["posterior"] == pytest.approx(posterior, abs=2e-5)
        if abs(posterior - 0.5) > 1e-4:
            assert (got[key]["language"], got[key]["accepted"]) == (language, accepted)


def test_odd_pages_are_brute_force(spark):
    docs = [("the cat and the dog", "en"), ("the house", "en"), ("der Hund und die Katze", "de"), ("das Haus", "de"), (None, "fr"), ("", "fr"), ("le chat", None)]
    rows = [(0, None, None), (1, "http://a.de/x", "<html lang=DE>das und die</html>"), (2, "http://a.de/y", "<p>the cat"), (3, "HTTP://B.DE:80/", "12 34"), (4, "nonsense", "<script>der die das</script>the"), (5, None, ""), (6, "http://a.de/z", "der Hund " * 40_000), (7, "http://a.de/x", "<html lang=DE>das und die</html>")]
    model = langid.fit(spark.createDataFrame([(*d, 1) for d in docs], "text string, lang string, _own int"))
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, language string")
    got = {r["page_id"]: (r["language"], r["posterior"], r["accepted"]) for r in langid.identify_pages(pages, model).collect()}
    want = brute(docs, rows)
    assert set(got) == set(want)
    for key in want:
        assert got[key][1] == pytest.approx(want[key][1], abs=1e-4) and (abs(want[key][1] - 0.5) < 1e-3 or got[key][::2] == want[key][::2])


def test_pipeline_stages_take_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, _own int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        assert name == "sequences" or out.columns == docs.columns
