"""Edge cases that all operators share: nulls, empty and long texts, ties and repeated rows, empty tables, clashing names."""

import time

import pytest
from pyspark.sql import functions as F

from strataforge.llm import common, hnsw, html_extraction, language_id, lm_scoring, mixing, packing, secrets, simhash, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, key string, h long, n string, score string"
LONG = "lorem ipsum token=abcdefghijklmn dolor " * 4000


def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), "w", "k", 1, "n", "s") for r in rows], DOCS)


ODD = [(1, None, "en", "a"), (2, "", None, None), (3, "  \n\t ", "en", "a"), (4, LONG, "de", "b"), (None, "no id here", None, None), (5, "same text", "en", "a"), (5, "same text", "en", "a"), (6, "same text", "en", "a"), (7, "😀 42 !", "en", ""), (8, "the threat is real", "en", "a"), (9, "der die das und", "de", "b")]

RUN = {
    "mixing": lambda d, s: mixing.mix_sources(d),
    "lm": lambda d, s: lm_scoring.score_documents(d, common.crc_mod("doc_id", 10) != 0, common.crc_mod("doc_id", 10) == 0, common.crc_mod("doc_id", 10) == 1),
    "simhash": lambda d, s: simhash.near_duplicates(d),
    "toxicity": lambda d, s: toxicity.score_documents(d, s.createDataFrame([(5, 1), (8, 0), (None, 1), (9, None), (77, 1), (9, 3)], "doc_id long, toxic int"), F.lit(True), common.crc_mod("doc_id", 5) == 0),
    "secrets": lambda d, s: secrets.digests(d),
    "language": lambda d, s: language_id.identify(d, F.lit(True), common.crc_mod("doc_id", 4) == 2),
    "packing": lambda d, s: packing.pack_documents(d),
}


@pytest.mark.parametrize("name", RUN)
def test_odd_documents(spark, name):
    got = RUN[name](docs(spark, ODD), spark).collect()
    ids = sorted((r.doc_id for r in got if name != "packing" or r.start == 0), key=lambda x: (x is None, x))
    assert ids == [1, 2, 3, 4, 5, 5, 6, 7, 8, 9, None]
    assert RUN[name](docs(spark, []), spark).count() == 0
    assert RUN[name](docs(spark, [(1, None, None, None)]), spark).count() == 1
    if name == "language":
        assert {r.doc_id: r.lang_pred for r in got}.items() >= {1: "und", 2: "und", 3: "und", 7: "und", 9: "de"}.items()
    if name == "secrets":
        assert {r.doc_id: r.n_assign for r in got}[4] == 4000
    if name == "simhash":
        assert {r.doc_id: r.component_id for r in got}.items() >= {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}.items()


VECTORS = "vec_id long, embedding array<float>, label int, v string, h string, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "v", "h", "n") for r in rows], VECTORS)


BAD = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [float("nan"), 1.0], 1), (4, [1.0, None], 1), (5, [float("inf"), 0.0], 1), (6, [], 1), (7, [1.0, 2.0], None), (None, [1.0, 2.0], 1)]


def test_odd_vectors(spark):
    good = [(50, [1.0, 0.5], 1), (51, [1.0, 0.5], 1), (52, [2.0, 1.0], 1), (53, [-1.0, 0.5], 1), (54, [1.0, 0.5], 2), (100, [1.0, 0.5, 0.2], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(vectors(spark, BAD + good)).collect()}
    assert got == {1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True), 6: (0, 6, True), 7: (0, 7, True), None: (0, None, True), 50: (2, 50, True), 51: (2, 50, False), 52: (2, 50, False), 53: (0, 53, True), 54: (0, 54, True), 100: (0, 100, True)}
    assert hnsw.near_duplicates(vectors(spark, [])).count() == 0
    ranked = topk.top_k(vectors(spark, BAD + good)).where("query_id = 50").orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in ranked] == [(1, 52, 163840), (2, 7, 131072), (3, 51, 81920), (4, 54, 81920), (5, 2, 0)]
    assert topk.top_k(vectors(spark, [])).count() == 0 and topk.top_k(vectors(spark, [(50, [1.0], 1)])).count() == 0


SENTENCE = "A long sentence of the article, with words."


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p"), (4, "u", "<article><p>a &amp; b<script>x<p>y</script><!-- z --> c<i>d</i></p></article>"), (4, "u", "<article><p>a &amp; b</p></article>"), (5, "u", "<article>" + f"<p>{SENTENCE}</p>" * 3000 + "</article>")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = html_extraction.extract(df).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got) and {r.page_id: r.text for r in got if r.page_id < 4} == {1: "", 2: "", 3: ""}
    assert sorted(r.text for r in got if r.page_id == 4) == ["a & b", "a & b cd"]
    assert max(r.n_chars for r in got) == 3000 * (len(SENTENCE) + 1) - 1
    assert html_extraction.extract(df.limit(0)).count() == 0


def test_pages_with_scripts_and_formulas(spark):
    inside = {
        "<script>for(i=0;i<n;i++){}</script>": "", "<SCRIPT>if(a<b){x='</p>'}</SCRIPT ><style>a>b{}</style>": "", "<textarea>x <y </textarea>": "",
        "<template><p>t</p><template>u</template><p>v</p></template>": "", "<select><option>one<option>two</select>": "",
        "<p>So <math><mi>e</mi><mo>=</mo><mn>1</mn><annotation>e=1</annotation></math> holds.</p>": "So e=1 holds.",
        f"<noscript><p>{SENTENCE}</p></noscript>": SENTENCE, f"<object data=x><p>{SENTENCE}</p></object>": SENTENCE, "<p>An <svg><title>t</title><path d=z /></svg> icon.</p>": "An icon.",
    }
    for part, text in inside.items():
        found = [b[1] for b in html_extraction.blocks(f"<article><p>{SENTENCE}</p>{part}<p>{SENTENCE}</p></article>")]
        assert found == [SENTENCE, *[text] * (text != ""), SENTENCE], part
    script = "<script>for(i=0;i<n;i++){}</script>"
    df = spark.createDataFrame([(1, "u", f"<body>{script}<article>" + f"<p>{SENTENCE}</p>" * 5 + "</article></body>")], "page_id long, url string, html string")
    assert html_extraction.extract(df).first().text == " ".join([SENTENCE] * 5)


def test_broken_pages_take_linear_time():
    words = lambda i: f"c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}"
    pages = {
        "<a " * 100_000: 0, '<a x="' * 100_000: 0, "<" * 100_000: 1, "<!-- " * 100_000: 0, "<!x" * 100_000: 0, "<script>" * 50_000: 0, "<div class='a b'><p>x" * 10_000: 10_000,
        "".join(f"<div class={words(i)}>x" for i in range(10_000)): 10_000, "<p><table>" + "<blockquote>x" * 10_000: 10_000, "<div>" * 5000 + "</section>x" * 20_000: 20_000,
    }
    for source, found in pages.items():
        began = time.process_time()
        assert len(html_extraction.blocks(source)) == found
        assert time.process_time() - began < 5, source[:20]
    assert [b[1] for b in html_extraction.blocks("<p>a</p><script>for(i=0;i<n;i++){}</script><p>b < c <3 d</p><!-->e<!--->f<!-- g -->h<a title=don't>i</a><b x='>'>j</b>")] == ["a", "b < c <3 d", "efhij"]
