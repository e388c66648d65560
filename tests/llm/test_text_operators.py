import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlspike.llm import decontaminate, html_extract, mixing, pseudonyms, token_counts


def test_mixing_follows_targets(docs):
    texts = [("w " * (1 + i % 7)).strip() for i in range(300)] + [None, "", "\x0b a b "]
    sources = [["a", "b", "c", None][min(3, i % 11 // 3)] for i in range(303)]
    d = docs(texts, [*range(301), 7, None], sources)
    got = mixing.mix(d).collect()
    sizes = Counter()
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, open_, target = sum(sizes.values()), set(names), {}
    while True:  # share; what is above a cap is shared again
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    target |= {s: unit * weight[s] for s in open_}
    assert len(got) == 303
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 2 * 7 for s in names)
    assert sum(taken.values()) <= sum(sizes.values())
    key = lambda rows: sorted((str(r.doc_id), r.size, r.taken) for r in rows)
    assert key(got) == key(mixing.mix(d.repartition(7), partitions=9).collect())
    assert mixing.mix(docs([])).count() == 0


def test_mixing_by_shelves(docs, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_A_BIN", 2)
    d = docs([("w " * (1 + i % 5)).strip() for i in range(200)])
    key = lambda rows: sorted((r.doc_id, r.size, r.taken) for r in rows)
    want = key(mixing.mix(d).collect())
    monkeypatch.setattr(mixing, "BINS_A_SHELF", 3)
    assert key(mixing.mix(d).collect()) == want


def test_mixing_one_source_and_no_words(docs):
    assert {(r.size, r.taken) for r in mixing.mix(docs(["a b", "c"], sources=["x", "x"])).collect()} == {(2, 2), (1, 1)}
    assert {r.taken for r in mixing.mix(docs(["", None], sources=["x", None])).collect()} == {0}


ITEM = "The quick brown fox jumps over the lazy dog while seventeen purple elephants are dancing gracefully under a silver moon tonight, and nobody in the village has ever asked them why."


def test_contamination(spark, docs):
    edited = ITEM.replace("purple", "purpel").replace("village", "villages")
    texts = ["start " + ITEM + " end", "x " + ITEM.upper().replace(" ", "\n") + " y", "pre " + edited, ITEM[:60], None, "", "clean words only " * 50, ITEM + " " + ITEM, "ünïcödé " * 3 + ITEM, ITEM[20:120] + " and more"]
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "short one"), (None, ITEM), (5, "unrelated " + "qwerty uiop " * 20)], "item_id long, text string")
    got = decontaminate.contaminated_spans(docs(texts), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, 1) for i in (0, 1, 2, 7, 8, 9)}
    spans = {r.doc_id: texts[r.doc_id].encode()[r.start : r.stop].decode() for r in got}
    assert spans[0].startswith("The quick") and spans[0].endswith("why")
    assert {r.doc_id: r.edits for r in got}[0] == 0
    clean = decontaminate.drop_contaminated(docs(texts), items)
    assert sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 6] and clean.columns == docs(texts).columns
    assert decontaminate.contaminated_spans(docs([]), items).count() == 0
    assert decontaminate.contaminated_spans(docs(texts), items.where("false")).count() == 0
    assert len(list(decontaminate.blocks(items, limit=50))) > 1


def test_contamination_at_every_offset(spark, docs):
    flat = re.sub(r"[^a-z0-9]+", " ", ITEM.lower()).strip()
    texts = [f"zq {flat[i : i + 80]} vx" for i in range(len(flat) - 79)]
    items = spark.createDataFrame([(1, ITEM), (2, "They don't know that it's a 'quoted' passage, and that's all we've said about it.")], "item_id long, text string")
    assert decontaminate.drop_contaminated(docs(texts), items).count() == 0
    curly = ["They don\u2019t know\u00a0that it\u2019s a \u2018quoted\u2019 passage\u2014and\u3000that\u2019s all we\u2019ve said about it\u2026"]
    assert [(r.item_id, r.edits) for r in decontaminate.contaminated_spans(docs(curly), items).collect()] == [(2, 0)]


def test_pseudonyms(spark):
    texts = ["card 4929963689861572, again 4929 9636 8986 1572", "bad 4929963689861573", "+1 (551) 555-0826 42.160.119.139 300.1.1.1", "Mail lyhe.24@mail4.example.com", "2020-02-29 2021-02-29", 'token = "186661156f3f9905942d70850a01cbf23a203f82"', None, "", "v 2.0 $1 \\1", "4929963689861572", "123-45-6789 000-12-3456"]
    df = spark.createDataFrame([(i, t, "k", "x") for i, t in enumerate(texts)], "doc_id int, text string, found string, new string")
    rows = {r.doc_id: r for r in pseudonyms.pseudonymise(df, "k").collect()}
    a, b = re.findall(r"\d{16}|\d{4} \d{4} \d{4} \d{4}", rows[0].text)
    luhn = lambda s: sum((int(c) * (1 + i % 2)) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(s))) % 10 == 0
    assert a == b.replace(" ", "") == rows[9].text != "4929963689861572" and luhn(a)
    assert [rows[i].text for i in (1, 6, 7, 8)] == [texts[i] for i in (1, 6, 7, 8)]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} (\d{1,3}\.){3}\d{1,3} 300\.1\.1\.1", rows[2].text) and rows[2].n_replaced == 2
    assert re.fullmatch(r"Mail [a-z]{4}\.\d\d@mail4\.example\.com", rows[3].text) and "lyhe" not in rows[3].text
    assert rows[4].text.endswith(" 2021-02-29") and rows[4].n_replaced == 1
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', rows[5].text) and rows[5].text != texts[5]
    assert rows[10].n_replaced == 1 and rows[10].text.endswith("000-12-3456")
    other = {r.doc_id: r.text for r in pseudonyms.pseudonymise(df, "other key").collect()}
    assert other[9] != rows[9].text
    plan = pseudonyms.pseudonymise(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_whole_secrets(spark):
    long, jwt = "Ab3" * 1000, "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.c2lnbmF0dXJl-_x"
    df = spark.createDataFrame([(0, f"token={long}."), (1, f"secret: '{jwt}' end"), (2, "password=0123456789abcdef. Next")], "doc_id int, text string")
    rows = {r.doc_id: r for r in pseudonyms.pseudonymise(df, "k").collect()}
    assert [rows[i].n_replaced for i in range(3)] == [1, 1, 1]
    assert re.fullmatch(r"token=([A-Z][a-z][0-9]){1000}[.]", rows[0].text) and rows[0].text[6 + 128 :] != long[128:] + "."
    assert all(a != b for a, b in zip(re.fullmatch(r"secret: '(.*)' end", rows[1].text)[1].split("."), jwt.split("."), strict=True))
    assert re.fullmatch(r"password=[0-9a-f]{16}[.] Next", rows[2].text)


def test_pseudonyms_are_permutations(spark):
    days = spark.sql("SELECT explode(sequence(date'1900-01-01', date'2099-12-31')) AS d").select(F.monotonically_increasing_id().alias("doc_id"), F.col("d").cast("string").alias("text"))
    out = pseudonyms.pseudonymise(days, "k")
    assert tuple(out.agg(F.count_distinct("text"), F.sum("n_replaced")).first()) == (73049, 73049)
    nets = spark.range(5000).selectExpr("id AS doc_id", "'10.0.' || (id DIV 256) || '.' || (id % 256) AS text")
    assert pseudonyms.pseudonymise(nets, "k").select("text").distinct().count() == 5000


@pytest.mark.parametrize("block", [3, 7, 1 << 20])
def test_token_counts(spark, docs, monkeypatch, block):
    import base64

    import public_tokenizers
    import tiktoken

    monkeypatch.setattr(token_counts, "BLOCK_TOKENS", block)
    with open(token_counts.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["hello world", None, "", "", "a " * 500, "<|endoftext|> is text", "ünïcödé", "x"] * 3
    d = docs(texts)
    index = token_counts.write_token_files(d, token_counts.new_path(spark, "test-tokens"))
    counted = token_counts.scan_token_files(index.select("file"), block=block)
    got = index.join(counted, ["file", "ordinal"]).collect()
    assert {r.key: r.n_tokens for r in got} == {i: len(coder.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert token_counts.token_counts(docs([])).count() == 0


def test_token_file_without_last_separator(spark, tmp_path):
    (tmp_path / "a.tok").write_bytes(b"".join(int(i).to_bytes(2, "little") for i in (1, 2, 50256, 50256, 3)))
    got = token_counts.scan_token_files(spark.createDataFrame([(str(tmp_path / "a.tok"),)], "file string"), block=2).orderBy("ordinal").collect()
    assert [(r.ordinal, r.n_tokens, r.ended) for r in got] == [(0, 2, True), (1, 0, True), (2, 1, False)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="ad">Buy</div><div id="cookie-notice">We use cookies</div><{tag}><h1>Head {n} &amp; more</h1><p>First {n}<br>line &lt;b&gt;
 <p><b>Second</b> {n}&nbsp;x<script>track()</script></p><aside>Side</aside><form><p>Mail me</p></form><section class="comments"><p>Nice!</p></section></{end}><div class="sidebar"><p>Links</p></div><footer>&copy; us</footer></body></html>"""


def page(n, tag="article"):
    return PAGE.replace("{tag}", tag).replace("{end}", tag.split()[0]).replace("{n}", str(n))


def test_main_text(spark):
    plain = [page(i, 'div class="body"') for i in range(4)]
    rows = [(i, "https://a.example/x", page(i)) for i in range(4)] + [(10 + i, "https://b.example/x", p) for i, p in enumerate(plain)]
    rows += [(20, None, page(20)), (21, "nonsense", None), (22, "https://c.example", ""), (23, "https://c.example", "just text &lt; 3"), (24, "https://c.example", "<p>unclosed <b>page"), (25, "https://c.example", "<nav>only</nav><!-- open"), (None, None, page(1))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, slots string")
    got = {r.page_id: r for r in html_extract.extract_main_text(df).collect()}
    want = lambda n: f"Head {n} & more\nFirst {n} line <b>\nSecond {n} x"
    assert all(got[i].text == want(i) for i in range(4))
    assert all(got[10 + i].text == want(i) for i in range(4))
    assert got[20].text == want(20) and got[None].text == want(1)
    assert [got[i].text for i in (21, 22, 23, 24, 25)] == ["", "", "just text < 3", "unclosed page", ""]
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.extract_main_text(df.where("false")).count() == 0


def test_markup_is_found_in_the_page_itself(spark):
    dotted = "\u0130" * 30  # has two characters in lower case
    pages = [
        f"<html><body><article><p>{dotted}</p><script>var a = 1;</SCRIPT ><p>After the script</p></article></body></html>",
        "<html><head><title>T</title><body><article><p>Whole text</p><script>x = '</scripts>'</script><p>More</p></article><header>H</header></body></html>",
        "<html><head><title>T</title></head><body><article><p>" + "Long word " * 200_000 + "</p></article></body></html>",
    ]
    df = spark.createDataFrame([(i, f"https://{i}.example/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_main_text(df).collect()}
    assert got == {0: dotted + "\nAfter the script", 1: "Whole text\nMore", 2: ("Long word " * 200_000).strip()}


def classes(pages):
    """Brute force: the tokens of each equivalence class, by whole occurrence vectors."""
    counts = [{t[0]: t[2] for t in html_extract.Page(p).tokens()} for p in pages]
    found = {}
    for path in {p for c in counts for p in c}:
        found.setdefault(tuple(c.get(path, 0) for c in counts), set()).add(path)
    return {v: t for v, t in found.items() if sum(x > 0 for x in v) >= html_extract.LEAST_PAGES and len(t) >= html_extract.LEAST_TOKENS}


@pytest.mark.parametrize("times", [1, 2])
def test_templates_match_brute_force(spark, times):
    source = lambda i: f"<html><body><div class=top><p>Same</p></div><div class=body><p>Text {i}</p>" + "<section class=part><p>Odd %d</p></section>" % i * (i % 2) + f"</div><table class=rare{i}><tr><td>x</td></tr></table></body></html>"
    pages = [source(i) for i in range(9)]
    df = spark.createDataFrame([("h", i, p) for i, p in enumerate(pages)] * times, "host string, page long, html string")
    (row,) = html_extract.templates(df).collect()
    said = {}
    for p in pages:
        for t in html_extract.Page(p).tokens():
            said.setdefault(t[0], set()).add(t[5])
    valid = set().union(*classes(pages).values())
    assert set(row.slots) == {t for t in valid if len(said[t]) > 1} and set(row.fixed) == {t for t in valid if len(said[t]) == 1}


def test_repeated_pages(spark):
    df = spark.createDataFrame([(i, "https://a.example/x", page(i, 'div class="body"')) for i in range(4)] * 2, "page_id long, url string, html string")
    got = [(r.page_id, r.text) for r in html_extract.extract_main_text(df).collect()]
    assert sorted(got) == sorted((i, f"Head {i} & more\nFirst {i} line <b>\nSecond {i} x") for i in range(4) for _ in range(2))


def test_hosts_have_templates(spark):
    df = spark.createDataFrame([("h", i, page(i, 'div class="body"')) for i in range(5)] + [("k", 1, page(1))], "host string, page long, html string")
    found = {r.host: r.slots for r in html_extract.templates(df).collect()}
    assert set(found) == {"h"} and len(found["h"]) == 1


def test_template_decides_before_tags(spark):
    # the article element holds most of each page, but the same on every page of the host: what varies is the text
    teaser = "<article class=teaser><p>" + "Our best offers of the season. " * 8 + "</p></article>"
    source = lambda i: f"<html><body>{teaser}<div class=text><p>Page {i} tells its own story {i * 7}</p></div><article class=more><p>Offers</p></article></body></html>"
    df = spark.createDataFrame([(i, "https://d.example/x", source(i)) for i in range(5)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract_main_text(df).collect()} == {i: f"Page {i} tells its own story {i * 7}" for i in range(5)}


def test_article_spread_over_containers(spark):
    source = lambda i: f"<html><body><section class=intro><p>Intro of page {i}</p></section><section class=body><p>The body of page {i} is longer, {i * 7}</p></section>" + (f"<section class=extra><p>Only {i}</p></section>" if i == 1 else "") + f"<ul><li><a href=/{i}>Link {i}</a></ul><div class=legal><p>All rights</p></div></body></html>"
    text = lambda i: f"Intro of page {i}\nThe body of page {i} is longer, {i * 7}" + ("\nOnly 1" if i == 1 else "")
    df = spark.createDataFrame([(i, "https://e.example/x", source(i)) for i in range(5)] + [(9, "https://f.example/x", source(9))], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_main_text(df).collect()}
    assert got == {**{i: text(i) for i in range(5)}, 9: text(9) + "\nAll rights"}
