"""Archives, main text, conversations and shards."""

import hashlib
import os
import random
import re
import types
import zlib

import numpy as np
import pytest
from conftest import prose

from docloom.llm import chat, maintext, sharding, warc


def test_archive_contract(spark):
    big, small = "é" * 600, "s" * 999
    rows = [(1, "u1", big), (7, None, big), (3, "a\r\nX-Key: 9", big), (4, "u", small), (5, "u", small), (6, "u", None), (8, "u", ""), (9, "u", "b" * 1000), (None, "u", big), (10, "u", "n" * 1500), (10, "u", "n" * 1500), (2, "u", "n" * 1500), (None, "n", "only" * 300)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, sha256 string, key string").repartition(3)
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.pages_archive(pages).collect())
    want = []
    for k, _, h in rows:
        data = (h or "").encode()
        same = [x for x, _, y in rows if (y or "").encode() == data and x is not None]
        revisit = len(data) >= 1000 and bool(same) and k != max(same)
        want.append((str(k), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert got == sorted(want, key=lambda x: (x[0], x[1], x[2]))


def test_archive_restores_records(spark, tmp_path):
    rows = [(1, "http://a/", "x" * 2000), (2, "http://b/", "x" * 2000), (3, "http://c/", "päge")]
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w/payloads")).count() == 2
    records = {r["key"]: bytes(r["record"]) for r in warc.read_records(spark, str(tmp_path / "w")).collect()}
    head, http, body = records[3].split(b"\r\n\r\n", 2)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and f"Content-Length: {len(http) + 4 + 5}".encode() in head
    assert http.startswith(b"HTTP/1.1 200 OK\r\n") and http.endswith(b"Content-Length: 5") and body == "päge".encode() + b"\r\n\r\n"
    assert b"WARC-Type: revisit" in records[1] and b"WARC-Refers-To: " in records[1] and records[1].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    damaged = spark.read.parquet(str(tmp_path / "w/payloads")).selectExpr("sha256", "encode('z', 'UTF-8') as payload")
    damaged.write.parquet(str(tmp_path / "d/payloads"))
    with pytest.raises(Exception, match="damaged payload"):
        warc.verified_payloads(spark, str(tmp_path / "d")).collect()


def test_every_record_has_an_id_of_its_own(spark, tmp_path):
    rows = [(i, "u", "x" * 2000) for i in (1, 2, 3, 3, None)] + [(4, "u", "small")] * 3
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), str(tmp_path / "w"))
    found = [(r["key"], r["record_type"], *re.findall(r"WARC-(?:Record-ID|Refers-To): (\S+)", bytes(r["header"]).decode())) for r in warc.read_headers(spark, str(tmp_path / "w")).collect()]
    ids = {x[2]: x[0] for x in found}
    assert len(ids) == len(rows)
    assert sorted(str(x[0]) for x in found if x[1] == "revisit") == ["1", "2", "None"] and {ids[x[3]] for x in found if x[1] == "revisit"} == {3}


def test_a_very_long_payload(spark):
    rows = [(i, "u", "é" * 3_000_000) for i in range(3)]
    got = warc.pages_archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["refers_to"]) for r in got) == [(0, 6_000_000, 2), (1, 6_000_000, 2), (2, 6_000_000, None)]


def test_empty_archive(spark):
    assert warc.pages_archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


LONG = "word " * 40


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("   ", ""), ("<p>a", "a"), ("plain text", "plain text"),
    ("<article><h1>T</h1><p>a &amp;amp; b\n  c<br>d<p>e</article>", "T\n\na &amp; b c d\n\ne"),
    ("<nav><a href=x>menu</a></nav><main><p>one</p><aside>side</aside><p>two</p></main><footer>f</footer>", "one\n\ntwo"),
    ('<article><p>x</p><div class="ad">buy</div><section id="comments"><article class="comment">nice</article></section><p>y</p></article>', "x\n\ny"),
    (f"<div><a href=1>Home</a></div><h1>Title</h1><p>{LONG}</p><p>ok.</p><ul class='share-buttons'><li>tweet</ul><p>{LONG}</p><div>© 2020</div>", f"Title\n\n{LONG.strip()}\n\nok.\n\n{LONG.strip()}"),
    (f"<div>Site</div><nav><p>a<p>b<p>c</nav><h1>T</h1><p>{LONG}<div class='advert'><p>1<p>2<p>3<p>4</div><p>end.</p><div class=cookie-notice><p>We use cookies {LONG}</div>", f"T\n\n{LONG.strip()}\n\nend."),
    (f"<main><p>Section</p><article><p>{LONG}</p></article><p>Next</p></main>", LONG.strip()), (f"<main><p>{LONG}</p><article><p>x</p></article></main>", f"{LONG.strip()}\n\nx"),
    ("<article><script>var a='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes</p><form><p>name</p></form>", "yes"),
    ("<article><p>cut of", "cut of"), ("<article><p>a</p><p", "a"), ("<article><p>a &am", "a &am"), ('<article><p title="a>b">x</p>', "x"),
    ("<article><p>a<b>b</b>c <i>d</i></p></article>", "abc d"), ("<body class='has-sidebar'><article><p>in</p></article><p>out</p></body>", "in"),
    ("<article><header><h1>Head</h1><p>by me</p></header><p>t</p></article>", "Head\n\nt"), ("<div role=navigation>n</div><article>m</article><div hidden>h</div>", "m"),
])
def test_main_text(page, want):
    assert maintext.main_text(page) == want


def test_article_is_only_a_hint():
    body = [f"{i} {LONG}".strip() for i in range(25)]
    card = '<article class="card"><p>A teaser of forty characters, or so.</p></article>'
    text = "".join(f"<p>{x}</p>" for x in body)
    got = maintext.main_text(f"<div>{text}</div><ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul>{card}")
    assert got == "\n\n".join(body)
    assert maintext.main_text(f"<article><h1>T</h1>{text}<p>End.</p></article><div><p>{LONG}</p></div>") == "\n\n".join(["T", *body, "End."])


def test_unmarked_pages_lose_no_section():
    long, short = [f"{i} {LONG}".strip() for i in range(9)], "A closing section of one short paragraph, which is nevertheless longer than eighty characters."
    text, links = "".join(f"<p>{x}</p>" for x in long), "<ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul>"
    head = ["Title", "Subtitle", "By one", "1 May", "Place"]
    top = "".join(f"<p>{x}</p>" for x in head)
    assert maintext.main_text(f"{top}{text}") == "\n\n".join([*head, *long])
    assert maintext.main_text(f"<p>{short}</p>{links}{text}{links}<p>Brief.</p>{links}<p>{short}</p>{links}") == "\n\n".join([short, *long, "Brief.", short])
    law = "Copyright law changed in 1998, and that is all there is to say about it."
    for last in (law, "(c) The third clause.", f"© is a sign. {LONG}".strip()):
        assert maintext.main_text(f"{text}<p>{last}</p>") == "\n\n".join([*long, last])
    for notice in ("© 2020", "Copyright 2020 Me", "Copyright Me. All rights reserved.", "All rights reserved", "(c) 2020 Me"):
        assert maintext.main_text(f"{text}<p>{notice}</p>") == "\n\n".join(long)


@pytest.mark.parametrize("around", ["<article>@</article>", "<div>@</div>"])
def test_ambiguous_words_need_another_sign(around):
    parts = [
        (f'<div class="article-header"><h1>Title</h1></div><p>{LONG}1</p>', f"Title|{LONG}1"),
        (f'<section id="discussion"><h2 id="discussion-1">Discussion</h2><p>{LONG}2</p></section>', f"Discussion|{LONG}2"),
        (f'<h2 id="related-work">Related work</h2><p>{LONG}3</p>', f"Related work|{LONG}3"),
        (f'<section id="side-effects"><h2>Side effects</h2><p>None.</p></section><p>{LONG}4</p>', f"Side effects|None.|{LONG}4"),
        (f'<div class="social-history"><p>No smoker.</p></div><div class="legal-notes"><div id="notice"><p>{LONG}5</p></div></div>', f"No smoker.|{LONG}5"),
        ('<div class="related-posts"><h3>Related</h3><a href=1>One of the other articles</a></div><div class="share-bar"><span>Tweet</span></div>', ""),
        ('<div class="share">Share it with all of your friends.</div><div class="comment">A fine article, I liked it.</div>', ""),
    ]
    page, want = around.replace("@", "".join(p for p, _ in parts)), "|".join(w for _, w in parts if w).split("|")
    assert maintext.main_text(page) == "\n\n".join(want)


@pytest.mark.parametrize(("piece", "want"), [
    ("<svg-icon name=a></svg-icon>", ""), ("<title-bar>b</title-bar>", "b"), ("<select-box>c</select-box>", "c"), ("<svg/>", ""), ("<svg width='1' />", ""), ('<svg a="/>"/>', ""),
    ("<svg a='/'><text>no</text></svg>", ""), ("<svg\n><title>no</title></svg>", ""), ("<math/>", ""), ("<math><mi>x</mi><mo>=</mo><mn>1</mn></math>", "x=1"),
    ("<object data=o><p>d</p></object>", "d"), ("<canvas>e</canvas>", "e"), ("<select><option>no</select>", ""), ("<script src=a>no</script>", ""), ("<style/>no</style>", ""),
])
def test_raw_text_ends_where_its_element_does(piece, want):
    assert maintext.main_text(f"<article><p>one</p>{piece}<p>two</p></article>") == "\n\n".join(x for x in ("one", want, "two") if x)


def generated(r: random.Random) -> tuple[str, list[str], bool]:
    """A page, the blocks of its article, and whether it marks it. Short lines stand apart from unmarked articles, behind links."""
    marked = r.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div itemprop=\"articleBody\">", "</div>"), None, None])
    links = lambda: "<ul>" + "".join(f'<li><a href="/{i}">{prose(r, 2)}</a>' for i in range(r.randint(4, 9))) + "</ul>"
    furniture = [
        lambda: f"<aside><h3>{prose(r, 3)}</h3><p>{prose(r, 30)}</p></aside>", lambda: f'<div class="advert">{prose(r, 12)}</div>', lambda: f'<div class="newsletter-signup"><p>{prose(r, 20)}</p></div>',
        lambda: f"<form><p>{prose(r, 9)}</p><input name=q><button>go</button></form>", lambda: "<script>if (a < b) { c('<p>no</p>') }</script>", lambda: f'<p hidden>{prose(r, 15)}</p>', lambda: f"<!-- <p>{prose(r, 5)}</p> -->",
    ]
    html, want = [], []

    def block(tag, text):
        words = [f"<b>{w}</b>" if r.random() < 0.1 else f'<a href="#">{w}</a>' if r.random() < 0.02 else w for w in text.split()]
        html.append(f"<{tag}>{r.choice([' ', chr(10) + '  ']).join(words)} &amp; co.</{tag}>")
        want.append(f"{text} & co.")

    html.append(f"<header><p>{prose(r, 8)}</p></header><div>{prose(r, 2)}</div><nav>{links()}</nav>{links()}")
    html.append(marked[0] if marked else "<div>")
    block("h1", prose(r, 5))
    block("p", prose(r, r.randint(40, 120)))
    for _ in range(r.randint(2, 12)):
        block(r.choice(["p", "p", "p", "blockquote", "h2", "pre"]), prose(r, r.choice([3, 10, 40, 90])))
        if r.random() < 0.4:
            html.append(r.choice(furniture)())
    block("p", prose(r, 50))
    html.append(marked[1] if marked else "</div>")
    html.append(f'<section id="comments"><article class="comment"><p>{prose(r, 60)}</p></article></section>{links()}<div>{prose(r, 2)}</div><footer><p>{prose(r, 40)}</p></footer>')
    return "".join(html), want, marked is not None


def test_generated_pages_and_what_the_windows_decide(monkeypatch):
    pages = [generated(random.Random(i)) for i in range(120)]
    for page, want, _ in pages:
        assert maintext.main_text(page) == "\n\n".join(want)
    assert 30 < sum(m for *_, m in pages) < 90
    monkeypatch.setattr(maintext, "stretches", lambda lengths, surge: [(0, len(lengths))])
    assert all((maintext.main_text(page) == "\n\n".join(want)) == m for page, want, m in pages)


def test_main_text_is_linear():
    page = "<article>" + "<p>x " * 20_000 + "<" * 20_000 + "</article>"
    assert maintext.main_text(page).startswith("x\n\nx")


def test_pages_text(spark):
    rows = [(1, None, "<article>a  b</article>"), (1, None, "<article>a  b</article>"), (None, "u", None)]
    got = sorted(((str(r["page_id"]), r["url"], r["text"], r["n_chars"]) for r in maintext.pages_text(spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars long")).collect()), key=str)
    assert got == sorted([("1", None, "a b", 3), ("1", None, "a b", 3), ("None", "u", "", 0)], key=str)
    assert maintext.pages_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- conversations -------------------------------------------------------------------------------------


def brute_chat(rows):
    convs: dict = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    told = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in convs.items()}
    out = []
    for c, t in told.items():
        if any(len(o) > len(t) and o[: len(t)] == t for o in told.values()):
            continue
        if any(o == t and ((d is not None), d or 0) < ((c is not None), c or 0) for d, o in told.items()):
            continue
        out.append((str(c), len(t), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in t)))
    return sorted(out)


def test_chat_against_brute_force(spark):
    r = random.Random(6)
    rows = []
    for c in range(60):
        n = r.randint(1, 4)
        rows += [(c, i, r.choice(["user", "assistant"]), r.choice("ab")) for i in range(n)]
    rows += [(100, 0, None, None), (101, 0, "", ""), (102, None, "user", "a"), (102, 0, "user", "b"), (103, 0, "user", "x"), (103, 0, "user", "x"), (None, 0, "user", "q"), (None, 1, "user", "q"), (104, 0, "user", "q"), (105, 1, "b", "1"), (105, 1, "a", "2"), (105, 1, "a", "1")]
    df = spark.createDataFrame([(*x, "e", 1) for x in rows], "conv_id long, turn long, role string, text string, conv string, n int").repartition(4)
    assert sorted((str(x["conv_id"]), x["n_turns"], x["text"]) for x in chat.render(df).collect()) == brute_chat(rows)
    plan = chat.render(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_no_conversations(spark):
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- shards ---------------------------------------------------------------------------------------------


def test_shard_contract(odd, odd_rows, none):
    for df, rows in ((odd, odd_rows), (none, [])):
        got = sharding.documents_shards(df).collect()
        text = lambda t: (t or "").encode()
        assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(k), len(text(t)) + 8, zlib.crc32(text(t))) for k, t, *_ in rows)
        counts = [0] * 24
        slots: dict = {}
        for r in got:
            assert r["law"] == "rows" and r["grown_shard"] is None
            counts[r["shard"]] += 1
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert max(counts) - min(counts) <= 1
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_matrix_rows_fit_together():
    sizes, cells = np.array([5, 0, 17, 3, 40]), sharding.cell_sizes(65, 4, 3)
    rows = np.stack([sharding.matrix_row(sizes, cells, i, 1) for i in range(5)])
    assert (rows.sum(1) == sizes).all() and (rows.sum(0) == cells).all() and (rows >= 0).all()


def test_shuffle_is_uniform(spark):
    n, hits = 60, np.zeros((60, 4))
    for seed in range(60):
        for r in sharding.shuffle_to_shards(spark.range(0, n, 1, 3), 4, seed, 2).collect():
            hits[r["id"], r["shard"]] += 1
    assert ((hits - 15) ** 2 / 15).sum() < 180 + 4 * (2 * 180) ** 0.5


def test_large_hypergeometric():
    rng = np.random.default_rng(0)
    draws = [sharding.hypergeometric(rng, 3 * 10**9, 10**9, 4 * 10**5) for _ in range(30)]
    assert abs(np.mean(draws) - 3 * 10**5) < 400 and np.std(draws) > 50


def test_same_seed_same_places(spark):
    df = spark.range(0, 500, 1, 5)
    a, b = (sorted(sharding.shuffle_to_shards(df, 7, 3).collect()) for _ in range(2))
    assert a == b and a != sorted(sharding.shuffle_to_shards(df, 7, 4).collect())
    assert prose(random.Random(0), 3)


def test_cells_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 7)
    out = sharding.shuffle_to_shards(spark.range(0, 1000, 1, 5), 3).toPandas()
    assert sorted(out.id) == list(range(1000))
    assert {s: sorted(g.slot) for s, g in out.groupby("shard")} == {s: list(range(334 if s == 0 else 333)) for s in range(3)}


def test_other_rows_in_the_second_pass_end_the_job(spark, tmp_path):
    def shrinking(batches):
        from pyspark import TaskContext

        mark = str(tmp_path / f"read-{TaskContext.get().partitionId()}")
        again = os.path.exists(mark)
        open(mark, "w").close()
        for i, b in enumerate(batches):
            yield b.slice(0, b.num_rows - 1) if again and i == 0 else b

    df = spark.range(0, 400, 1, 4).mapInArrow(shrinking, "id long")
    with pytest.raises(Exception, match="held other rows"):
        sharding.shuffle_to_shards(df, 3).collect()


def test_clashing_columns_are_refused(odd):
    with pytest.raises(ValueError, match="already a column"):
        sharding.shuffle_to_shards(odd, slot_out="piece")
    with pytest.raises(ValueError, match="already a column"):
        maintext.extract(odd.selectExpr("doc_id", "text", "'' as html"))


def test_a_cluster_needs_a_shared_folder():
    from docloom.llm.common import shared_folder

    nothing = types.SimpleNamespace(get=lambda *a: None)
    cluster = types.SimpleNamespace(master="spark://host:7077", getConf=lambda: nothing, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(types.SimpleNamespace(conf=nothing, sparkContext=cluster))
    cluster.getCheckpointDir = lambda: "hdfs://host/folder"
    assert shared_folder(types.SimpleNamespace(conf=nothing, sparkContext=cluster)) == "hdfs://host/folder"
