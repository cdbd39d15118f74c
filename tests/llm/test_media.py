import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from docloom.llm.media import decode_png, documents_media, encode_png, padded, read_items, references, resolve, with_items


def test_png_round_trip():
    for data in (b"", b"a", bytes(range(256)) * 3, b"x" * 64, b"y" * 65):
        p = padded(data)
        assert len(p) % 64 == 0 and len(p) >= 64 and p.startswith(data) and not any(p[len(data) :])
        assert decode_png(encode_png(p)) == p
    damaged = bytearray(encode_png(padded(b"abc")))
    damaged[45] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        decode_png(bytes(damaged))


def test_contract_on_odd_rows(odd, odd_rows):
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"], r["feature"]) for r in documents_media(odd).collect())
    want = []
    for k, t, *_ in odd_rows:
        raw = (t or "").encode()
        p = padded(raw)
        want.append((str(k), len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert [g[:5] for g in got] == sorted(want)
    by_text: dict = {}
    for g in got:
        assert by_text.setdefault(g[3], g[5:]) == g[5:]


def test_empty_table(none):
    assert documents_media(none).count() == 0


def test_items_keep_order_and_captions():
    items = read_items('<p>one <b>two</b></p><figure><img src="sha256:aa" alt="alt"><figcaption>Cap &amp; tion</figcaption></figure>three<img src="http://x/y.png" alt="plain"><script>no</script><p>four')
    assert [(x["position"], x["kind"], x["text"] or x["ref"], x["caption"]) for x in items] == [
        (0, "text", "one two", None), (1, "media", "sha256:aa", "Cap & tion"), (2, "text", "three", None), (3, "media", "http://x/y.png", "plain"), (4, "text", "four", None),
    ]
    assert read_items(None) == read_items("") == []


@pytest.mark.parametrize(("page", "want"), [
    ("<figure><img src=a><figcaption>one<br>two</figcaption></figure>", [("a", "one two")]),
    ("<figure><figcaption>before</figcaption><img src=a><img src=b></figure><img src=c>", [("a", "before"), ("b", "before"), ("c", None)]),
    ("<head><title>t</title><meta charset=utf-8><body><p>text<img src=a alt=x>", [("text", None), ("a", "x")]),
    ("<figure><img src=a><figcaption><p>cut <b>of", [("a", "cut of")]), ("<figure><img src=a alt=x><figcaption></figcaption></figure></figure></p>end", [("a", "x"), ("end", None)]),
    ("<figure><img src=a><figure><img src=b><figcaption>in</figcaption></figure><figcaption>out</figcaption></figure>", [("a", "out"), ("b", "out")]),
    ("<p>1<video src=v></video>2<script>x<img src=no></script>", [("1", None), ("v", None), ("2", None)]),
])
def test_captions_of_odd_pages(page, want):
    assert [(x["text"] or x["ref"], x["caption"]) for x in read_items(page)] == want


def test_clashing_columns_are_refused(spark):
    with pytest.raises(ValueError, match="already a column"):
        with_items(spark.createDataFrame([("", 1)], "html string, items int"))


def test_resolving_against_a_plain_lookup(spark):
    r = random.Random(8)
    digests = [hashlib.sha256(bytes([i])).hexdigest() for i in range(6)]
    pages = []
    for k in range(40):
        parts = [r.choice([f"<p>text {i}", f'<figure><img src="sha256:{digests[min(r.randrange(9), 5)]}"><figcaption>cap {k} {i}</figcaption></figure>', '<img src="http://x" alt="far">']) for i in range(r.randint(0, 12))]
        pages += [(None if k % 9 == 0 else k, "".join(parts), None, k)] * r.choice([1, 1, 3])
    known = {d: i for i, d in enumerate(digests[:5])}
    df = with_items(spark.createDataFrame(pages, "k int, html string, _row string, _ref int").repartition(5))
    assert df.columns == ["k", "_row", "_ref", "items"]
    out = resolve(df, spark.createDataFrame([(d, i) for d, i in known.items()], "digest string, _facts int"))
    assert out.columns == df.columns
    plain = lambda k, n, items: (str(k), n, [(x["position"], x["kind"], x["text"], x["ref"], x["caption"], f) for x, f in items])
    got = [plain(x["k"], x["_ref"], [(i, i["fact"] and i["fact"]["_facts"]) for i in x["items"]]) for x in out.collect()]
    want = [plain(k, n, [(i, known.get((i["ref"] or "")[7:])) for i in read_items(h)]) for k, h, _, n in pages]
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(f is not None for *_, items in got for *_, f in items)


def test_resolving_keeps_positions(spark):
    d = "a" * 64
    pages = spark.createDataFrame([(1, f'<p>t<img src="sha256:{d}" alt="c">u'), (2, None), (3, '<img src="sha256:' + "b" * 64 + '">'), (1, f'<p>t<img src="sha256:{d}" alt="c">u')], "k int, html string")
    facts = spark.createDataFrame([(d, 7)], "digest string, size int")
    out = resolve(with_items(pages), facts).collect()
    assert len(out) == 4
    by = {r["k"]: r["items"] for r in out}
    assert [(x["position"], x["kind"], x["fact"] and x["fact"]["size"], x["caption"]) for x in by[1]] == [(0, "text", None, None), (1, "media", 7, "c"), (2, "text", None, None)]
    assert by[2] == [] and by[3][0]["fact"] is None
    assert references(with_items(pages)).where(F.col("digest") == d).count() == 2
