"""Archives in packages and page texts."""

from __future__ import annotations

import hashlib
import io
import zipfile

import pytest

from rasterlake.llm import warc_zip as Z, wrapper as X

PAGE = "page_id long, url string, html string, row long, host string, text string, package string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "h", "t", "p") for r in rows], PAGE)


def test_round_trip_with_revisits(spark):
    big, long = "ä" * 600, "<p>" + "word " * 400_000
    rows = [(1, "http://a/1", big), (5, None, big), (5, "http://a/5", big), (2, "u\r\nrl", "ä" * 499), (3, "x", "ä" * 499), (4, "y", None), (6, "z", ""), (None, "q", big), (7, "r", long), (8, "r", long)]
    got = Z.round_trip(table(spark, rows)).collect()
    want = []
    for page, _, text in rows:
        raw = (text or "").encode()
        same = [p for p, _, t in rows if t == text and p is not None]
        revisit = len(raw) >= 1000 and page != max(same)
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=repr) == sorted(want, key=repr)
    assert Z.round_trip(table(spark, [])).count() == 0


def test_packages_are_plain_zip_archives(spark):
    rows = [(i, f"http://h/{i}", f"text {i} " * 200) for i in range(40)]
    packages = Z.write_packages(table(spark, rows), package_bytes=2000)
    paths = [r.package for r in packages.collect()]
    assert len(paths) > 4
    store, name = Z.open_store(paths[0])
    with store.open_input_file(name) as f:
        raw = f.read()
        assert [m.name for m in Z.directory(f)] == [Z.ARCHIVE, Z.INDEX]
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
    texts = {r.page_id: bytes(r.payload).decode() for r in Z.read_packages(packages).collect()}
    assert texts == {i: t for i, _, t in rows}


def test_foreign_packages(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"text {i}") for i in range(5)]
    path = Z.write_packages(table(spark, rows).coalesce(1)).first().package
    store, name = Z.open_store(path)
    with zipfile.ZipFile(store.open_input_file(name)) as z, zipfile.ZipFile(tmp_path / "plain.zip", "w") as out:
        out.comment = b"PK\x05\x06 in a comment"
        out.writestr(Z.ARCHIVE, z.read(Z.ARCHIVE))  # classic directory, no index
    plain = spark.createDataFrame([(str(tmp_path / "plain.zip"),)], "package string")
    assert sorted(r.page_id for r in Z.read_packages(plain).collect()) == list(range(5))
    with zipfile.ZipFile(tmp_path / "packed.zip", "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr(Z.ARCHIVE, b"x" * 100)
    store, name = Z.open_store(str(tmp_path / "packed.zip"))
    with store.open_input_file(name) as f, pytest.raises(ValueError, match="not stored"):
        Z.data_start(f, Z.directory(f)[0])
    with pytest.raises(ValueError, match="digest"):
        Z.parse(Z._record({"page_id": 1, "url": None, "payload": b"abc", "payload_digest": "0" * 40, "record_type": "response", "refers_to": None}))


def test_tree_matching():
    a, b = X.tree(["/b/ul/li", "/b/div/p", "/b/div.x/p"]), X.tree(["/b/div/p", "/b/div.x/h1", "/b/div.x/p", "/b/f"])
    size, pairs = X.match(a, b)
    assert size == 5 and dict(pairs) == {p: p for p in ("/b", "/b/div", "/b/div/p", "/b/div.x", "/b/div.x/p")}
    assert X.match({}, b) == (0, [])


def test_constant_blocks_are_template_and_marked_parts_go(spark):
    def page(i):
        return (
            f"<html><head><title>t{i}</title></head><body><div class=top>Our Site</div><ul class=x><li><a href=/{i}>link {i}</a></ul>"
            f"<div id=c><h1>Title {i}</h1><p>Text &amp; more  {i}<br>and\n <b>so</b> on<p>Second {i}</div><div class='comments'><p>me too {i}</p></div>"
            f"<aside>side {i}</aside><script>if (a<b) '</p>{i}'</script><p class=foot>All rights reserved</p>"
        )

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(6)]
    got = {r.page_id: r.text for r in X.extract(table(spark, rows)).collect()}
    assert got == {i: f"Title {i}\nText & more {i} and so on\nSecond {i}" for i in range(6)}


def test_odd_pages(spark):
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    rows = [(1, None, None), (2, "no url", ""), (3, "http://x/", deep), (4, "http://x/", "<" * 50_000), (5, "http://x/", "<article>a<nav>n</nav><p>b &am c"), (5, "http://x/", "<article>a<nav>n</nav><p>b &am c"), (None, "http://x/", "<!-- open"), (6, "http://x", "<script>never closed <p>x")]
    got = sorted([(r.page_id, r.text if len(r.text) < 100 else len(r.text), r.n_chars) for r in X.extract(table(spark, rows)).collect()], key=repr)
    assert got == sorted([(1, "", 0), (2, "", 0), (3, "deep", 4), (4, 50_000, 50_000), (5, "a\nb &am c", 9), (5, "a\nb &am c", 9), (None, "", 0), (6, "", 0)], key=repr)
    assert X.extract(table(spark, [])).count() == 0


def test_constant_blocks_and_links_inside_an_article_go(spark):
    def page(i):
        return (
            f"<body><div class=top>Our Site</div><article><h1>Title {i}</h1><p>Body {i} goes on and on<div class=x9>We value your privacy</div>"
            f"<ul><li><a href=/{i}>link {i}</a></ul><p>End {i}</article><p>seen {i}</p></body>"
        )

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(6)]
    got = {r.page_id: r.text for r in X.extract(table(spark, rows)).collect()}
    assert got == {i: f"Title {i}\nBody {i} goes on and on\nEnd {i}" for i in range(6)}


def test_a_body_stands_beside_an_article_teaser(spark):
    def body(i):
        return f"Body {i}: " + f"sentence {i} of the long text " * 20

    in_main = [(i, f"http://m.example/{i}", f"<body><main><h1>Title {i}</h1><p>{body(i)}</main><article><p>Teaser {i}</article></body>") for i in range(6)]
    plain = [(10 + i, f"http://p.example/{i}", f"<body><div><h1>Title {i}</h1><p>{body(i)}</div><div><article>Teaser {i}</article></div></body>") for i in range(6)]
    got = {r.page_id: r.text for r in X.extract(table(spark, in_main + plain)).collect()}
    want = {i: f"Title {i}\n{body(i).strip()}" for i in range(6)}
    assert got == want | {10 + i: t for i, t in want.items()}


def test_elements_with_names_of_their_own_on_every_page_are_one_slot(spark):
    a, b = X.tree(["/b/div.u/p", "/b/div.v/h1", "/b/ul/li"]), X.tree(["/b/div.x/h1", "/b/div.x/p", "/b/ul/li", "/b/div.v2"])
    assert dict(X.match(a, b)[1]) == {"/b": "/b", "/b/div.v": "/b/div.x", "/b/div.v/h1": "/b/div.x/h1", "/b/ul": "/b/ul", "/b/ul/li": "/b/ul/li"}

    def page(i):
        own = "abcdef"[i] * 3
        return f"<body><div class=n{own}>We value your privacy<i>!</i></div><div class=c{own}><h1>Title {i}</h1><p>Body {i} goes on</div><p>Made by us</body>"

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(6)]
    got = {r.page_id: r.text for r in X.extract(table(spark, rows)).collect()}
    assert got == {i: f"Title {i}\nBody {i} goes on" for i in range(6)}


def test_elements_that_differ_in_their_fifth_name_are_two_slots():
    assert len({X._label("div", f'class="a b c d {n}"')[0] for n in ("e", "f")}) == 2


def test_a_long_attribute_is_no_text():
    assert [b.text for b in X.blocks(f'<body><div data-x="{"y" * 5000}">text</div></body>')] == ["text"]
