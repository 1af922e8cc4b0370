import numpy as np

from newsloom.llm import crf, html_extract


def test_viterbi_and_marginals_against_enumeration():
    from itertools import product

    r = np.random.default_rng(0)
    for _ in range(30):
        per = r.integers(1, 6, 3)
        u, trans = r.normal(size=per.sum()), r.normal(size=(2, 2))
        p, expected, log_z = crf.marginals(u, per, trans)
        label = crf.viterbi(u, per, trans)
        at, z_all, e_all = 0, 0.0, np.zeros((2, 2))
        for n in per:
            own = u[at : at + n]
            paths = list(product((0, 1), repeat=int(n)))
            s = np.array([sum(own[i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)) for y in paths])
            w = np.exp(s) / np.exp(s).sum()
            z_all += np.log(np.exp(s).sum())
            assert np.allclose(p[at : at + n], [sum(a for a, y in zip(w, paths, strict=True) if y[i]) for i in range(n)])
            assert tuple(label[at : at + n]) == paths[int(s.argmax())]
            for a, y in zip(w, paths, strict=True):
                for i in range(n - 1):
                    e_all[y[i], y[i + 1]] += a
            at += n
        assert np.isclose(log_z, z_all) and np.allclose(expected, e_all)


def test_held_out_layouts():
    m = html_extract.model()
    right = n = 0
    for page in html_extract.labelled_pages(150, seed=123):
        b = html_extract.blocks(page)
        clean = [(t.replace(html_extract.GOOD, "").replace(html_extract.BAD, "").strip() or "x", marks, share) for t, marks, share in b]
        number, w, trans = m
        u = np.array([sum(w[number[f]] for f in html_extract.features(*x) if f in number) for x in clean])
        for (t, _, _), y in zip(b, crf.viterbi(u, np.array([len(b)]), trans), strict=True):
            n += 1
            right += (html_extract.GOOD in t) == bool(y)
    assert right / n > 0.98


def test_pages(spark):
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><header class="masthead">Site</header><nav><ul><li><a href="/a">Home<li><a href="/b">News</a></ul></nav>'
        '<div class="cookie-notice"><p>We use cookies.</p></div><!-- <p>no</p> --><article><h1>A &amp;  b&nbsp;c</h1><p>First &lt;para&gt; <b>bold</b>\n text.<p>Second &#233;&copy one.<br>'
        '<script>var t="</p>";</script><div class="ad">Buy this thing now.</div><p>1 < 2 holds.</p></article><section class="comments"><p>Nice article, thank you.</p></section>'
        '<aside class="sidebar"><p>Related things to read.</p></aside><form><label>Mail</label><input><button>Go</button></form><footer>&copy; site</footer></body></html>'
    )
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<p"), (1, "u", page), (5, "x", "<script>never ends <p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = html_extract.main_text(df).collect()
    assert len(got) == 6
    text = next(r.text for r in got if r.page_id == 1)
    assert text == "A & b c\nFirst <para> bold text.\nSecond é© one.\n1 < 2 holds."
    assert all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (2, 3, 5)] == ["", "", ""]
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_broken_pages_are_read_in_one_pass():
    import time

    for unit in ('<a x="', "<div", "<!", "<p title='a<b", '<b x="1" y="2" ', "<div><b>", "</div>", "&", "<li>", "<td>x", "<script", "<"):
        began = time.time()
        html_extract.blocks(unit * 40_000)
        assert time.time() - began < 20, unit
    assert html_extract.blocks('<p title="a < b" class=x>t')[0][0] == "t"
    assert [b[0] for b in html_extract.blocks("<table><tr><td>a<td>b<tr><td>c</table>d")] == ["a", "b", "c", "d"]
    assert [b[0] for b in html_extract.blocks("<ul><li>a<ul><li>b</ul><li>c</ul>")] == ["a", "b", "c"]
    assert [b[0] for b in html_extract.blocks("<h1>a<p>b<h2>c</h2>")] == ["a", "b", "c"]


def test_open_heads_and_embedded_text():
    told = lambda page: [b[0] for b in html_extract.blocks(page)]
    for begin in ("<body>", "<div>", "<p>", "", "<span>"):
        assert told(f"<html><head><meta charset=x><title>T</title><style>p{{}}</style>{begin}Text of it.") == ["Text of it."]
    assert told("<head>\n<title>T</title></head><body>a") == ["a"]
    for tag in "math svg object canvas audio video map".split():
        assert told(f"<article><p>one <{tag}>two</{tag}> three</p></article>") == ["one two three"]
    assert told("<p>a <svg/>b<select><option>no</select><button>no</button></p><p>c") == ["a b", "c"]
