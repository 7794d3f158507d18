"""Language, quality, personal data and page text: held-out accuracy, brute force and odd rows."""

import random
import re
import zlib

import numpy as np
import pytest

from rollbook.llm import html, langid, pii, quality
from rollbook.llm.common import numbered

SMALL = "/root/testdata/sf0.01"
ODD = [(None, None, None, "x"), (1, "", "en", "x"), (1, "", "en", "x"), (2, "123 !?", None, "x"), (3, "word " * 50_000, "en", "x"), (None, "some text", "de", "x")]
SCHEMA = "doc_id long, text string, lang string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


def test_numbering_has_no_gaps_in_hot_groups(spark):
    rows = spark.createDataFrame([(None if i % 3 == 0 else i % 5, i) for i in range(500)] + [(1, 7)] * 20, "g int, v int")
    got = numbered(rows, ["g"], ["v"], "at", blocks=8).collect()
    assert len(got) == 520
    for g in (None, 0, 1, 2, 3, 4):
        own = sorted(r["at"] for r in got if r["g"] == g)
        assert own == list(range(len(own)))


def test_language_is_right_on_the_held_out_fold(docs):
    found = langid.accuracy(langid.languages(docs), docs)
    for fold in (True, False):
        own = found[found["held_out"] == fold]
        assert (own["right"] * own["rows"]).sum() / own["rows"].sum() > 0.97


def test_language_of_odd_rows(spark, docs):
    model = langid.fit(docs)
    got = langid.predict(spark.createDataFrame(ODD, SCHEMA), model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert [r["lang_pred"] == "und" for r in sorted(got, key=lambda r: (r["doc_id"] or 0, r["lang"] or ""))] == [True, False, True, True, True, False]
    assert langid.languages(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.languages(docs.select("doc_id", "text", docs["lang"].substr(9, 1).alias("lang")).limit(5)).collect()} <= {"und", ""}


def test_kernel_counts_shared_grams():
    texts = ["abc", "abd", "xyz"]
    model = langid.Model.fit(texts, ["a", "b", "c"])
    grams = [set(langid.grams(t).tolist()) for t in texts]
    want = [[len(a & b) / np.sqrt(len(a) * len(b)) for b in grams] for a in grams]
    assert np.allclose(model.kernel(texts), want, atol=1e-5)


def test_quality_ranks_the_held_out_fold(docs, labels):
    got = quality.qualities(docs, labels).join(labels, "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    own = got[got["held_out"]]
    assert (own["predicted"] == own["quality"]).mean() > 0.95
    assert ((got["score"] >= 0.7) == (got["predicted"] == 1)).all() and got["score"].between(0, 1).all()


def test_quality_of_odd_rows(spark, docs, labels):
    odd = spark.createDataFrame(ODD, SCHEMA)
    got = quality.qualities(odd, labels).collect()
    assert len(got) == len(ODD) and all(r["score"] == 0 for r in got if r["doc_id"] == 1)
    assert quality.accepted(odd, labels).columns == odd.columns
    assert quality.qualities(docs, labels.limit(0)).count() == docs.count()


def brute_spans(text):
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, rule in rules.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "phone" and 9 <= len(digits) <= 15 \
                    or kind == "card" and 13 <= len(digits) <= 19 and pii.luhn(digits):
                yield kind, *m.span()


def test_base_spans_equal_the_rules():
    random.seed(1)
    parts = [*"0123456789..--@@++aB_% ()é", "256", "192.168.0.1", "4111111111111111", "a@b.c", "00000000000000000001.2.3.4"]
    for _ in range(5000):
        text = "".join(random.choices(parts, k=random.randint(0, 40)))
        assert pii.base_spans(text) == list(brute_spans(text)), text
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == [] and pii.base_spans(None) == []


def test_gradient_of_the_tagger():
    model = pii.Tagger.new()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 132, (3, 9)), rng.integers(0, 9, (3, 9))
    _, grad = model.loss(x, y)
    for name in ("hf", "xb", "out", "step", "first", "embed"):
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        kept, sides = model.p[name][at], []
        for d in (1e-3, -1e-3):
            model.p[name][at] = kept + d
            sides.append(model.loss(x, y)[0])
        model.p[name][at] = kept
        assert abs((sides[0] - sides[1]) / 2e-3 - grad[name][at]) < 2e-3 * max(1, abs(grad[name][at])), name


@pytest.fixture(scope="module")
def tagger(docs):
    return pii.train(docs)


def test_tagger_learns_and_base_spans_stay(docs, tagger):
    texts = [r["text"] for r in docs.where("text rlike '@'").limit(60).collect()]
    alone = pii.model_spans(texts, tagger)
    base = [{s for s in pii.base_spans(t) if s[0] == "email"} for t in texts]
    assert sum(len(b & set(a)) for a, b in zip(alone, base, strict=True)) > 0.3 * sum(map(len, base))
    for text, (own, added) in zip(texts, pii.find_spans(texts, tagger), strict=True):
        assert own == list(brute_spans(text))
        assert all(e <= s2 or e2 <= s for _, s, e in added for _, s2, e2 in own)


def test_personal_data_of_odd_rows_and_mask(spark, tagger):
    rows = spark.createDataFrame([(1, None, "a", 3), (2, "mail a.b@c.de or +1 (617) 555-2870, 10.0.0.1", "b", 3), (2, "", "c", 0), (3, "x" * 100_000 + " 4111111111111111", "d", 1)],
                                 "doc_id long, text string, _none string, n_chars long")
    got = {(r["doc_id"], r["spans"]): r for r in pii.annotated(rows, tagger).collect()}
    assert got[2, "email:5:13,ip:36:44,phone:17:34"]["n_phone"] == 1 and (1, "") in got and (2, "") in got and (3, "card:100001:100017") in got
    masked = {(r["doc_id"], r["kept"]): r for r in pii.masked(rows.withColumnRenamed("_none", "kept"), None).collect()}
    assert masked[2, "b"]["text"] == "mail <email> or <phone>, <ip>" and masked[2, "b"]["n_chars"] == 29 and masked[1, "a"]["text"] is None
    assert pii.train(rows.limit(0)) is None and pii.annotated(rows.limit(0), None).count() == 0


def test_article_text_equals_brute_force(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.main_text(pages).collect()}
    import html as entities
    for page in pages.collect():
        body = re.search(r"<article>(.*)</article>", page["html"], re.S)[1].replace("<br>", " ")
        want = (" ".join(entities.unescape(re.sub("<[^>]*>", "", z)).split()) for z in re.split(r"</?(?:p|h\d)\b[^>]*>", body))
        assert got[page["page_id"]] == "\n\n".join(w for w in want if w)


def test_repeated_branches_of_a_host_go_and_the_rest_stays(spark):
    page = "<body><div class=x>Same words on every page</div><section><p>Own words of page {0}</p><div class='comments'><p>me too</p></div></section><p>&lt;b&gt; &amp; c</p>"
    rows = [(i, f"http://h.example/{i}", page.format(i), "n") for i in range(20)]
    rows += [(90, None, None, "n"), (91, "odd", "", "n"), (92, "http://one.example/", page.format(92), "n"), (92, "http://one.example/", page.format(92), "n"), (93, "x", "<p>" + "w " * 50_000, "n")]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    text = {}
    for r in got.collect():
        text.setdefault(r["page_id"], []).append(r["text"])
    assert text[3] == ["Own words of page 3"]  # the shared line and the shared last block are on all pages
    assert text[92] == ["Same words on every page\n\nOwn words of page 92\n\n<b> & c"] * 2
    assert text[90] == text[91] == [""] and len(text[93][0]) == 99_999
    assert html.main_text(got.select("page_id", "url", got["text"].alias("html")).limit(0)).count() == 0


@pytest.mark.parametrize("size", [20_000, 20_001, 1_000_000])
def test_attributes_of_any_length_are_markup(size):
    value = "<a b='c'>" * (size // 9) + "x" * (size % 9)
    page = f'<p>one<img src="{value}">two</p><nav data-x="{value}"><p>menu</p></nav><div data-x="{value}" hidden><p>unseen</p></div><p title="{value}">three</p>'
    assert [b.text for b in html.blocks(page)] == ["onetwo", "three"]


def test_odd_quotes_and_names_in_values():
    texts = lambda page: [b.text for b in html.blocks(page)]
    assert texts("""<p title="hidden id"  data-hidden=no data-j='{"class": "nav"}'>kept</p>""") == ["kept"]
    assert texts("<p>1 < 2, a <b and c <i>d</i> it's <p title=x'>e</p>") == ["1 < 2, a <b and c d it's", "e"]
    for part in ("<a '\"", '<a "<b" ', "<a<a", "<a '<b\" "):
        page = part * 100_000
        assert texts(page + "<") == [" ".join((page + "<").split())]


@pytest.mark.parametrize("page,want", [
    ("<div class='layout has-sidebar'><article><p>a</p></article></div>", ["a"]),
    ("<main><div class='search-result-page'><p>a</p></div></main>", ["a"]),
    ("<p class='social-science'>a</p><p class='social-links'>b</p><div id=related-posts><p>c</p></div>", ["a"]),
    ("<h2 id='related-work'>a</h2><h2 id=comments>b</h2><p class=comments>c</p>", ["a", "b"]),
    ("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b</p><p><label>c</label></p>", ["a x=2 b", "c"]),
    ("<p>a</p><svg width=3><p>b</p>", ["a", "b"]),
    ("<p>a</p><svg><text>no</text></svg><p>b</p><script>if (a < b) no", ["a", "b"]),
    ("<p>a</p><div class='user-reviews'><p>me too</p></div><div class='film-reviews'><p>b</p></div>", ["a", "b"]),
    ("<div class='no-ads'><p>a</p></div><div class='ad-slot-3 wide'>b</div><form><label>c</label></form>", ["a"]),
])
def test_names_of_parts_and_of_subjects(page, want):
    assert [b.text for b in html.blocks(page)] == want


def test_a_teaser_is_not_the_article_and_the_tree_decides_beside_it(spark):
    teaser = "<article><p>Read also</p></article>"
    page = "<body><div class=x>The same long line of the house on every page there is</div><div class=story><p>Own story of page {0}, told at some length</p></div>" + teaser
    short = "<body><div class=x>The same long line of the house on every page there is</div><article><p>Note {0}</p></article>"
    rows = [(i, f"http://a.example/{i}", page.format(i)) for i in range(12)] + [(100 + i, f"http://b.example/{i}", short.format(i)) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Own story of page {i}, told at some length\n\nRead also" for i in range(12))
    assert all(got[100 + i] == f"Note {i}" for i in range(12))  # the line outside is long, but the tree has removed it


def test_quality_learns_from_every_labelled_row(spark):
    """The fit is that over all rows: a Newton fit of every pair in one bucket, and the exact quantile, rare labels repeated."""
    rng = np.random.default_rng(3)
    x, good = rng.normal(size=(400, quality.WIDTH)), np.arange(400) % 25 != 0
    x[good, 0] += 1.5
    rows = spark.createDataFrame([(i, bool(g), r.tolist()) for i, (g, r) in enumerate(zip(good, x, strict=True))], "id long, good boolean, x array<double>")
    model = quality.learn(rows)
    z = model.scaled(x)
    d = (z[good][:, None] - z[~good][None]).reshape(-1, quality.WIDTH)
    p = 1 / (1 + np.exp(d @ model.weights))
    assert np.allclose(model.mean, x.mean(0)) and np.abs(d.T @ p / len(d) - quality.PENALTY * model.weights).max() < 1e-6
    s = np.sort(z @ model.weights)
    assert np.isclose(model.cut, (s[15] + s[16]) / 2)
    sizes = {True: int(good.sum()), False: int((~good).sum())}
    kept = quality._buckets(rows, sizes)
    assert kept.where("good").count() == sizes[True] and kept.where("NOT good").count() == sizes[False] * kept.select("bucket").distinct().count()
