"""Licence sentences, URL rules, toxicity, line cleaning and main text."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from creditloom.llm import cleaning, extraction, licenses, toxicity, urls

# --- Licences -------------------------------------------------------------------------------

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software."""


def scanned(spark, *texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r for r in licenses.scan(docs).orderBy("doc_id").collect()]


def test_notices_in_order_and_after_a_line_without_a_mark(spark):
    rows = scanned(
        spark,
        "Some prose\nLicensed under the Apache License, Version 2.0.\nAll rights reserved.",
        "Released under the MIT  license! And more. Licensed under CC BY-NC 4.0.",
        MIT, None, "", "This program is free software; nothing else.",
    )
    assert [r.licenses for r in rows] == ["Apache-2.0,All-rights-reserved", "MIT,CC-BY-NC-4.0", "", "", "", ""]
    assert rows[2].sentence_ids == "mit-grant,mit-notice" and rows[2].n_unmatched == 2
    assert [r.n_unmatched for r in rows[3:]] == [0, 0, 1]


def test_longer_rules_take_their_sentences_first(spark):
    full = " ".join(f"{licenses.SENTENCES[name]}." for name in licenses.RULES[5][1])
    header = "The MIT License.\n" + full
    rows = scanned(spark, full, header, full + " And " + full)
    assert [r.licenses for r in rows] == ["MIT", "MIT", "MIT"]
    assert rows[2].n_unmatched == 3  # "and permission …" is no known sentence


MIT_FILE = f"""MIT License

Copyright (c) 2024 A. Name

{MIT.replace("conditions: The", "conditions:" + chr(10) * 2 + "The")}

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
GPL_NOTICE = """    <one line>
    Copyright (C) <year>  <name of author>

    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
APACHE_NOTICE = """   Copyright [yyyy] [name of copyright owner]

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""


def test_usual_wrapped_texts(spark):
    twice = MIT_FILE.replace("MIT License", "The MIT License (MIT)")
    rows = scanned(spark, MIT_FILE, twice, GPL_NOTICE, APACHE_NOTICE, "MIT License", "The MIT License (MIT)", GPL_NOTICE.replace("version 3", "version 2"), "MIT\n\nLicense\nx")
    assert [r.licenses for r in rows] == ["MIT", "MIT", "GPL-3.0-or-later", "Apache-2.0", "MIT", "MIT", "GPL-2.0-or-later", ""]
    assert [r.n_unmatched for r in rows] == [0] * 8


def test_licences_on_edge_cases(edge_documents, no_documents):
    assert licenses.scan(edge_documents).count() == edge_documents.count()
    assert licenses.scan(no_documents).count() == 0


# --- URLs -----------------------------------------------------------------------------------


def plain_host_path(url):
    rest = (url or "").partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain_rule(host, path):
    best = None
    for rule in urls.LISTED:
        name, slash, rest = rule.text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + rest):
            if best is None or len(rule.text) > len(best.text):
                best = rule
    return best


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.NET/en/x?y", "https://net/", "https://net",
    "x://internet/", "http://a.example.com/de/1", "http://a.example.com/den", "http://b.org/fr/2#t",
    "http://b.org/fr", "a://b://c.net/d", "http://example.net?q=/en/", "http://example.net/en/?q",
    "http://ÄÖ.net/ü", "http://example.com/de/", "http://u:p@example.com:80/de/",
]


def test_list_rules_equal_a_plain_reading(spark, sf_dir):
    real = [r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("url").collect()]
    given = URLS + real + real[:3]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string").withColumn("tokens", F.lit(1))
    found = urls.judge(pages).orderBy("page_id").collect()
    assert len(found) == len(given)
    for row, url in zip(found, given):
        host, path = plain_host_path(url)
        rule = plain_rule(host, path)
        assert (row.host, row.path, row.rule) == (host, path, rule and rule.text), url
        assert row.verdict == rule.verdict if rule else row.verdict in ("allow", "block")


def test_mined_rules_equal_counting(spark):
    rows = [(["a", "b"], "block")] * 30 + [(["a", "c"], "allow")] * 30 + [(["d"], "block")] * 20
    rows += [(["c", "e"], "allow")] * 3 + [(["z"], None)] * 50 + [([], "allow")]
    rules = urls.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.1, 0.9)
    assert {(r.tokens, r.verdict) for r in rules} == {(("b",), "block"), (("c",), "allow"), (("d",), "block")}
    data = spark.createDataFrame([(["a", "b"],), (["a"],), (["c", "x"],), (["b", "c"],), ([],)], "t array<string>")
    places = [r[0] for r in data.select(urls.mined_rule(F.col("t"), rules)).collect()]
    assert [None if p is None else rules[p].tokens for p in places[:3]] == [("b",), None, ("c",)]
    assert rules[places[3]].confidence == 1.0 and places[4] is None


def test_rules_may_need_four_tokens(spark):
    four = set("abcd")
    rows = [(sorted(four), "block")] * 30 + [(sorted(four - {gone}), "allow") for gone in four] * 15
    rules = urls.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.05, 0.9)
    assert [(r.tokens, r.verdict, r.confidence) for r in rules] == [(tuple("abcd"), "block", 1.0)]


def test_labels_decide_where_no_list_rule_does(spark):
    pages = spark.createDataFrame([(1, "http://casino.x.io/a"), (2, "http://news.x.io/a")], "page_id long, url string")
    labels = spark.createDataFrame(
        [(f"http://casino.s{i}.io/", "block") for i in range(40)] + [(f"http://news.s{i}.io/", "allow") for i in range(40)],
        "url string, label string",
    )
    assert {r.page_id: r.verdict for r in urls.judge(pages, labels=labels).collect()} == {1: "block", 2: "allow"}


def test_labels_of_documents_decide_and_not_the_list(spark):
    given = [f"http://h{i}.example.org/{'de' if i % 2 else 'es'}/{i}{('', '/', '.html')[i % 3]}?x" for i in range(1, 61)]
    given += [f"http://h.example.com/de/{i}" for i in range(61, 121)] + ["http://no.rule/fits"]
    pages = spark.createDataFrame(list(enumerate(given, 1)), "page_id long, url string")
    # The list blocks example.com/de/ and says nothing of example.org/de/.
    assert {r.verdict for r in urls.judge(pages).where("page_id <= 60").collect()} == {"allow"}
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(1, 61)] + [(1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    found = urls.judge(pages, labels=urls.document_labels(pages, labels)).collect()
    assert all(r.verdict == ("block" if r.page_id > 60 or r.page_id % 2 == 0 else "allow") for r in found if r.page_id < 121)
    assert [(r.verdict, r.mined_tokens) for r in found if r.page_id == 121] == [("allow", None)]


def test_urls_without_rows_or_rules(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(empty).count() == 0
    nothing = spark.createDataFrame([(1, None), (None, "http://q.zz/")], "page_id long, url string")
    assert {r.verdict for r in urls.judge(nothing).collect()} == {"allow"}


# --- Toxicity -------------------------------------------------------------------------------


def test_chain_finds_held_out_insults(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    known = labels.where(F.xxhash64("doc_id") % 4 != 0)
    held = labels.where(F.xxhash64("doc_id") % 4 == 0).select("doc_id", F.col("toxic").alias("truth"))
    judged = toxicity.judge(docs.where("lang = 'en'"), known, ["doc_id"]).join(held, "doc_id")
    table = {(r.truth, r.toxic): r["count"] for r in judged.groupBy("truth", "toxic").count().collect()}
    assert table.get((0, True), 0) <= 1
    assert table[(1, True)] >= 2 * table.get((1, False), 0)


def test_earlier_categories_feed_later_ones(spark):
    texts = [f"plain words number {'abcdefghij'[i % 10] * 5} here" for i in range(300)]
    rows = [(i, ("grumblecake " if i % 3 == 0 else "") + t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("first"), (F.col("doc_id") % 3 == 0).cast("int").alias("second"))
    chain = toxicity.fit(docs, labels, ["first", "second"])
    assert [len(link.earlier) for link in chain] == [0, 1] and chain[1].earlier[0] > 0
    assert chain[0].words["grumblecake"] > 0
    scored = toxicity.score(docs, chain, ["doc_id"]).collect()
    assert all((r.p_second > 0.5) == (r.doc_id % 3 == 0) for r in scored)


def test_toxicity_on_edge_cases(spark, edge_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (4, None, 1), (None, 0, 0), (5, 0, None)], "doc_id long, quality int, toxic int")
    assert toxicity.judge(edge_documents, labels, edge_documents.columns).count() == edge_documents.count()
    assert toxicity.judge(edge_documents, labels.limit(0), ["doc_id"]).where("toxic").count() == 0
    assert toxicity.judge(no_documents, labels, ["doc_id"]).count() == 0


# --- Line cleaning --------------------------------------------------------------------------


def plain_repeated(words, window=5):
    seen = {}
    for i in range(len(words) - window + 1):
        seen.setdefault(tuple(words[i : i + window]), []).append(i)
    return len({i + o for places in seen.values() if len(places) > 1 for i in places for o in range(window)})


def test_counts_equal_a_plain_reading(spark, sf_dir, edge_documents):
    texts = ["a b c d e f a b c d e", "x " * 50, "a b c d e a b c d e a b c d e q", "1 2 3 4 5 6 7\n1 2 3 4 5"]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for given in (docs, edge_documents):
        rows = given.select("doc_id", "text").collect()
        want = []
        for doc_id, text in rows:
            text = text or ""
            words = re.findall(r"[^\x20\x09-\x0D]+", text)
            lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            n, repeated = len(words), plain_repeated(words)
            want.append((
                str(doc_id), n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
                repeated, n < 10 or 100 * repeated > 20 * n,
            ))
        got = [
            (str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
            for r in cleaning.clean(given).collect()
        ]
        assert sorted(got) == sorted(want)


GOOD = "This is an ordinary sentence with enough words, and it ends well."


@pytest.mark.parametrize(
    "line, bad",
    [
        (GOOD, False), ("Is.", False), ("Licensed under the Apache License, Version 2.0.", False),
        ("Home | News | Sport | Contact", True), ("We use cookies on this site.", True),
        ("https://example.org/a/b", True), ("buy### now$$$ cheap*** pills%%%", True), ("--- 12 ---", True),
        ("WOW!! THIS!! IS!! LOUD!!", True), ("word " * 14, True), ("Short title here", False),
    ],
)
def test_line_rules(spark, line, bad):
    text = "\n".join([GOOD, line, GOOD.replace("ordinary", "other")])
    row = cleaning.clean(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (line not in row.clean_text.split("\n")) == bad
    assert row.kept == (not row.base_failed)


def test_words_are_split_once(spark):
    docs = spark.createDataFrame([(1, GOOD), (2, None)], "doc_id long, text string")
    found = cleaning.clean(docs)
    for columns in (found.columns, ["n_dup_lines"], ["kept"], ["clean_text"]):
        plan = found.select(*columns)._jdf.queryExecution().optimizedPlan().toString()
        splits = re.findall(r"(?<![a-z_])split\(", plan)
        assert len(splits) <= 3, (columns, len(splits))  # lines, spaced lines, words


def test_documents_that_lose_most_words_go(spark):
    text = GOOD + "\n" + "\n".join(f"a{i} | b{i} | c{i} | d{i} | e{i} | f{i}" for i in range(9))
    row = cleaning.clean(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.base_failed, row.kept, row.clean_text) == (False, False, GOOD)


# --- Main text ------------------------------------------------------------------------------

PAGES = {
    None: "", "": "", "<p></p>": "", "plain &amp; simple": "plain & simple",
    "<body><nav><a href=x>Menu one</a></nav><article><h1>A &lt; B</h1><p><b>First\n  line<br><p>Second &copy; <i>x</i>"
    "<script>var t='</p>';</script></article><footer>foot</footer>": "A < B\n\nFirst line\n\nSecond © x",
    "<body><div class='sidebar'>side text here</div><div id=main><p>" + "Long body text, with words. " * 9
    + "</p><p>More of it, with words.</p></div><div class=comments><p>First!</p></div>":
        ("Long body text, with words. " * 9).strip() + "\n\nMore of it, with words.",
    "<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table><form>f</form><!-- <p>no</p> --></article>": "one\n\ntwo\n\nx\n\ny",
    "<article class='post has-comments'><p>kept text</p><aside>no</aside><div class=\"ad\" title='a>b'>buy</div></article>": "kept text",
    "<article><p>unclosed <a href='q'>link": "unclosed link",
    "<main><p>a<div>b</div>c</p></main>": "a\n\nb\n\nc",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert extraction.main_text(page) == PAGES[page]


@pytest.mark.parametrize(
    "mark",
    [
        'style="overflow:hidden"', "style='overflow: hidden'", 'title="a hidden gem"', 'data-role="menu"', "data-hidden=no",
        'class="layout has-sidebar"', 'id="content-with-sidebar"', 'class="no-comments"', 'class="related-work"', 'class="widget"',
    ],
)
def test_marks_are_read_by_name_and_whole(mark):
    prose = "Long body text, with words. " * 9
    page = "<body><div class='site-footer'>foot</div><div {}><p>{}</p></div><div class='cookie-banner'>Cookies!</div></body>"
    assert extraction.main_text(page.format(mark, prose)) == prose.strip()
    assert extraction.main_text(f"<article {mark.replace('widget', 'post')}><p>{prose}</p></article>") == prose.strip()
    for gone in ("hidden", "HIDDEN=''", "aria-hidden=true", "role='menu'", "id=sidebar", "class='x ad'"):
        assert extraction.main_text(f"<main><p>kept</p><p {gone}>gone</p><p {mark.replace('widget', 'x')}>too</p></main>") == "kept\n\ntoo"


def test_long_comments_beside_an_article_go():
    page = "<article><p>short</p></article><div class=comments><p>" + "A long comment. " * 30 + "</p></div>"
    assert extraction.main_text(page) == "short"


def test_every_real_page_gives_its_article(spark, sf_dir):
    rows = extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(
        spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id"
    )
    import html as codes

    for row in rows.collect():
        inner = re.search(r"<article>(.*?)</article>", row.html, re.S)[1]
        parts = [" ".join(codes.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", re.sub("<br>", " ", inner))]
        assert row.text == "\n\n".join(filter(None, parts)) and row.n_chars == len(row.text)


def test_density_prefers_prose_to_links(spark):
    links = "".join(f"<li><a href=/{i}>A link with a rather long label {i}</a></li>" for i in range(30))
    prose = "".join(f"<p>Sentence number {i} tells something, at length and without links.</p>" for i in range(6))
    found = extraction.main_text(f"<body><div><ul>{links}</ul></div><div>{prose}</div></body>")
    assert found.startswith("Sentence number 0") and "A link" not in found and found.count("\n\n") == 5


def test_extraction_edge_rows(spark):
    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>x" * 5000, 2), (1, "u", "<p>x", 3)], "page_id long, url string, html string, text long")
    assert sorted(r.n_chars for r in extraction.extract(pages).collect()) == [0, 1, 5000 + 2 * 4999]
    assert extraction.extract(pages.limit(0)).count() == 0
