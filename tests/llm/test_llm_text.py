"""Per-document operators: language ID, repetition rules, HTML text, toxicity, LM scoring."""

import math
import re
import zlib

import numpy as np
import pytest

from carelake.llm import html_text, language_id, lm_scoring, queries, repetition, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")

EN = "the house and the garden with that other thing when they were there"
DE = "das haus und der garten mit dem anderen ding als sie dort waren nicht"


def by_id(frame):
    return {r["doc_id"]: r.asDict(recursive=True) for r in frame.collect()}


def documents(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_language_id_edge_cases(spark):
    train = spark.createDataFrame([(i, EN, "en") for i in range(5)] + [(9 + i, DE, "de") for i in range(5)] + [(20, None, "en"), (21, "x", None)], "doc_id long, text string, lang string")
    model = language_id.train(train)
    assert model.languages == ["de", "en"]
    texts = [None, "", "123 !!", EN, DE, (EN + " ") * 3 + (DE + " ") * 2, EN * 4000, EN]
    got = by_id(language_id.identify(documents(spark, texts), model))
    assert [got[i]["lang_pred"] for i in range(8)] == ["und", "und", "und", "en", "de", "en", "en", "en"]
    assert got[0]["score"] == 0 and got[0]["languages"] == []
    assert got[3]["score"] == 1 and {x["lang"] for x in got[5]["languages"]} == {"de", "en"}
    assert 0.5 < got[5]["score"] < 0.75
    nothing = language_id.train(train.where("false"))
    assert [r["lang_pred"] for r in language_id.identify(documents(spark, [EN, None]), nothing).collect()] == ["und", "und"]
    assert language_id.identify(documents(spark, [EN]).where("false"), model).count() == 0
    # all columns pass through, whatever their names
    odd = documents(spark, [EN, None, "7"]).selectExpr("*", "1 AS score", "'x' AS lang_pred")
    assert [tuple(r) for r in language_id.identified(odd, model).collect()] == [(0, EN, 1, "x")]


def test_mixture_matches_plain_em():
    """The vectorised inference against a word-by-word one, over all language sets."""
    rng = np.random.default_rng(1)
    bits = 10
    log_p = np.log(rng.dirichlet(np.ones(1 << bits) * 0.3, 3).T + 1e-9).astype(np.float32)
    model = language_id.Model(["a", "b", "c"], log_p, bits)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), rng.integers(1, 6))) for _ in range(n)) for n in (1, 3, 30, 200)]
    got = language_id.mixtures(texts, model)
    for text, pi in zip(texts, got, strict=True):
        g = language_id.trigrams([text], bits)
        words = np.add.reduceat(log_p[g.bucket], g.word_start, axis=0).astype(float)
        p = np.maximum(np.exp(words - words.max(axis=1, keepdims=True)), 1e-30)

        def em(start, steps, p=p):
            for _ in range(steps):
                r = start * p
                start = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
            return start, np.log((start * p).sum(axis=1)).sum()

        alone = (words - words.max(axis=1, keepdims=True)).sum(axis=0)
        full, full_loglik = em(np.full(3, 1 / 3), 8)
        best, cost = np.eye(3)[alone.argmax()], -2 * alone.max()
        if 2 * (full_loglik - alone.max()) > math.log(len(words) + 1):
            for size in (2, 3):
                keep = np.argsort(-full, kind="stable")[:size]
                start = np.zeros(3)
                start[keep] = np.maximum(full[keep], 1e-9)
                share, loglik = em(start / start.sum(), 8)
                if -2 * loglik + (size - 1) * math.log(len(words) + 1) < cost:
                    best, cost = share, -2 * loglik + (size - 1) * math.log(len(words) + 1)
        assert np.allclose(pi, best, atol=1e-6)


def test_language_id_held_out_accuracy(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.op1_language_id(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.98 * len(held)


def plain_repetition(text):
    text = text or ""
    words = WORDS.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)

    def covered(n):
        at = {}
        for i in range(len(words) - n + 1):
            at.setdefault(tuple(words[i : i + n]), []).append(i)
        return {i + k for places in at.values() if len(places) > 1 for i in places for k in range(n)}

    chars = sum(map(len, words))
    repeat = len(covered(8))
    failed = len(words) < 20 or 100 * repeat > 30 * len(words)
    seen, dup_chars = set(), 0
    for line in lines:
        dup_chars += sum(map(len, WORDS.findall(line))) if line in seen else 0
        seen.add(line)
    kept = not failed and dup_chars <= repetition.LINE_LIMIT * max(chars, 1) and all(
        sum(len(words[i]) for i in covered(n)) <= limit * max(chars, 1) for n, limit in repetition.LIMITS.items()
    )
    return (len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), dup, repeat, failed, kept)


def test_repetition_against_plain(spark):
    rng = np.random.default_rng(3)
    vocab = ["a", "bé", "c*", "dd", "e<", "名前", " x"]
    texts = [None, "", " \t\n", "one", "a b\na b\n\na b", "x " * 50, "\n".join(["l m n o p q r s t"] * 5), "w\x1cv " * 30]
    texts += [" ".join(rng.choice(vocab, rng.integers(0, 80))) + "\n" + " ".join(rng.choice(vocab, 9)) for _ in range(60)]
    texts += [" ".join(f"w{i}" for i in range(500)) + " " + " ".join(f"w{i}" for i in range(100)), " ".join(str(i) for i in range(30_000))]
    got = by_id(repetition.repetition_rules(documents(spark, texts)))
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) == plain_repetition(t), repr(t)[:80]
    assert repetition.repetition_rules(documents(spark, ["a"]).where("false")).count() == 0


def test_repetition_over_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.op7_repetition(spark, "/root/testdata/sf0.001").collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) == plain_repetition(docs[r["doc_id"]])


PAGE = (
    '<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body>'
    '<header><h1>Site</h1></header><nav class="menu"><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>'
    '<div id="wrap-{n}"><div class="post post-{n}"><h2>Title &amp; more</h2><p>First  paragraph\n with <b>bold</b> text &eacute; that goes on for some time.'
    '<p>Second <a href="/x">link</a> paragraph, long enough to matter to everyone here.</p><!-- <p>hidden</p> --><form><input value="x">Send</form>'
    '<div class="ad">Buy</div><section class="comments"><p>Reader says a lot, more than the article does, again and again and again.</p></section></div>'
    '<aside>Related stories</aside></div><footer>(c)</footer></body></html>'
)


def test_html_main_text(spark):
    pages = [(i, "https://h.example/a", PAGE.format(n=i)) for i in range(3)] + [
        (3, None, None), (4, "https://h.example/b", ""), (5, "not a url", "plain &lt;text&gt;"), (6, "https://h.example/c", "<p>no such path<p>at all"),
        (7, "https://other.example", "<div><p>open <b>never closed"), (8, "https://h.example/a", PAGE.format(n=0)), (9, "u", "<script>only"),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS path", "'x' AS host", "'y' AS text")
    got = {r["page_id"]: r for r in html_text.main_text(frame).collect()}
    want = "Title & more\nFirst paragraph with bold text é that goes on for some time.\nSecond link paragraph, long enough to matter to everyone here."
    assert [got[i]["text"] for i in (0, 1, 2, 8)] == [want] * 4
    assert got[0]["host_path"] == ">html>body>div>div.post.post-#"
    assert [got[i]["text"] for i in (3, 4, 5, 6, 7, 9)] == ["", "", "plain <text>", "no such path\nat all", "open never closed", ""]
    assert html_text.main_text(frame.where("false")).count() == 0


def test_html_consensus_overrules_a_page(spark):
    usual = '<body><div class="main"><p>{}</p></div><div class="teaser"><p>{}</p></div></body>'
    pages = [(i, "http://x.example/", usual.format("article words " * 20, "short")) for i in range(4)]
    pages.append((4, "http://x.example/", usual.format("brief article", "a teaser that is longer than its article by far " * 3)))
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[4] == "brief article"


def test_html_keeps_pages_of_other_templates(spark):
    words = "article words that go on " * 8
    usual = f'<body><div><p>{words}</p></div></body>'
    other = '<body><div>{}</div><section class="story"><p>' + "another text of this page " * 8 + "</p></section></body>"
    h = "https://many.example/"
    pages = [(i, h, usual) for i in range(6)] + [(6, h, other.format("box")), (7, h, other.format("")), (8, h, other.format('<p hidden>x</p>'))]
    # no host in the url: pages of other sites don't vote
    pages += [(10 + i, None, usual) for i in range(4)] + [(20, "x", '<body><div>a short notice of a few words only</div><section class="story"><p>' + "own text " * 6 + "</p></section></body>")]
    got = {r["page_id"]: r for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i]["text"] == words.strip() for i in [*range(6), *range(10, 14)])
    assert all(("another text of this page " * 8).strip() in got[i]["text"] for i in (6, 7, 8))
    assert ("own text " * 6).strip() in got[20]["text"] and got[20]["host_path"] is None


@pytest.mark.parametrize("name", ["layout no-sidebar", "has-sidebar", "page with-header", "long-form", "widget Blog", "search-results"])
def test_html_layout_classes_are_no_furniture(name):
    article = "the article goes on " * 10
    side = '<div class="sidebar">Side text</div><div class="comments">' + "a reader says more than all " * 20 + "</div>"
    for page in (f'<body><div class="{name}"><p>{article}</p></div><div class="sidebar">Side</div></body>', f'<body><div id="{name}"><p>{article}</p>{side if "-" in name and name.split("-")[0] not in ("long", "search") else ""}</div></body>'):
        assert html_text.extract(page, []) == article.strip()
    # around a main element no class counts
    assert html_text.extract(f'<body><div class="menu-layout header"><main><p>{article}</p></main><div class="menu">Side</div></div></body>', []) == article.strip()


@pytest.mark.parametrize("box", [
    'class="cookie-notice"', 'class="sidebar"', 'id="advert"', 'class="newsletter box"', 'class="site-nav"', 'class="notice"', 'class="search-form"', 'class="widget"', 'id="search-box"',
    'class="comments"', 'role="navigation"', 'style="color:red; display: none"', 'style="visibility:hidden"', 'hidden', 'class="share-bar"', 'class="widget widget-area"',
])
def test_html_furniture_goes_at_any_length(box):
    article, more = "the article goes on and on", "words that are no part of the article at all " * 30
    for tag in ("div", "section", "td"):
        assert html_text.extract(f"<body><div class='post'><p>{article}</p></div><{tag} {box}><p>{more}</p></{tag}></body>", []) == article
        # a page of nothing else is empty
        assert html_text.extract(f"<body><{tag} {box}><p>{more}</p></{tag}></body>", []) == ""


def test_html_votes_against_plain(spark):
    rng = np.random.default_rng(6)
    shapes = ['<body><div class="a"><p>{}</p></div></body>', '<body><section class="b c9"><p>{}</p></section></body>', '<body><article>{}</article></body>', '<body><div><div class="d">{}</div></div></body>']
    pages = []
    for i in range(300):
        h = ["http://one.example/x", "https://two.example:8080/", "http://THREE.example", None, "no host"][rng.integers(0, 5)]
        shape = shapes[min(int(rng.exponential(1.0)), 3)]
        pages.append((i, h, shape.format("words of it " * int(rng.integers(1, 30))) if rng.random() > 0.05 else None))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    votes = {}
    for _, url, page in pages:
        m = re.match(r"[a-z]+://([^/:]*)", (url or "").lower())
        if m and page:
            path, score = html_text.candidates(page)[0]
            at = votes.setdefault(m[1], {}).setdefault(path, [0, 0.0])
            at[0] += 1
            at[1] += score
    want = {}
    for h, paths in votes.items():
        every = sum(n for n, _ in paths.values())
        order = sorted(paths, key=lambda p: (-paths[p][0], -round(paths[p][1], 3), p))
        want[h] = [p for p in order if paths[p][0] >= html_text.VOTE_SHARE * every] or order[:1]
    got = {r["host"]: list(r["paths"]) for r in html_text.winning_paths(frame.select(html_text.host(frame.url).alias("host"), "html")).collect()}
    assert got == want and len(want) == 3
    # and each page is read at the first of its host's paths that it has
    texts = {r["page_id"]: r["text"] for r in html_text.main_text(frame).collect()}
    assert all(texts[i] == (" ".join(re.sub("<[^>]*>", " ", page).split()) if page else "") for i, _, page in pages)


def test_html_matches_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.op2_html_text(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.01/pages.parquet").count()
    met = 0
    for r in rows:
        assert r["n_chars"] == len(r["text"])
        m = re.search(r"/(\d+)(?:[#?/].*)?$", r["url"])
        if m and int(m[1]) in docs:  # the page shows this document below its heading
            met += 1
            assert r["text"].split("\n", 1)[-1].split() == docs[int(m[1])].split()
    assert met > 100


def test_grammar():
    weight = {"idiot": 5.0}

    def score(text):
        return toxicity.clause_score(text.split(), weight)

    plain = score("an idiot")
    assert plain == 5.0
    assert score("you are an idiot") == score("an idiot like you") == pytest.approx(7.0)
    assert score("not an idiot") == score("they said idiot") == pytest.approx(2.0)
    assert score("not one or two or idiot") == plain  # out of the negation's reach
    assert score("nothing here") == 0
    assert score("kill time") < score("kill you") == pytest.approx(1.4 * toxicity.THREAT_WEIGHT)


@pytest.mark.parametrize("said, factor", [
    ("i will kill you", 1.4), ("he said he will kill you", 0.4), ("you kill time", 1.4), ("kill time", 0.4), ("i will not kill you", 0.4), ("killing you", 1.4), ("he stabbed them", 1.4),
    ("they wrote that you kill", 0.4), ("i kill one two three four you", 0.4),
])
def test_threats(said, factor):
    assert toxicity.clause_score(said.split(), {}) == pytest.approx(factor * toxicity.THREAT_WEIGHT)


def plain_clause(words, weight):
    """The grammar by looking around each word."""
    kind = ["insult" if weight.get(w) else "threat" if w in toxicity.THREATS else "target" if w in toxicity.TARGETS else "not" if w in toxicity.NEGATIONS else "said" if w in toxicity.REPORTS else "" for w in words]
    total = 0.0
    for i, k in enumerate(kind):
        if k in ("insult", "threat"):
            weak = "not" in kind[max(0, i - 3) : i] or "said" in kind[:i]
            directed = "target" in kind[max(0, i - 4) : i] + kind[i + 1 : i + 5]
            factor = 0.4 if weak else 1.4 if directed else 1.0 if k == "insult" else 0.4
            total += factor * (weight[words[i]] if k == "insult" else toxicity.THREAT_WEIGHT)
    return total


def test_grammar_against_plain():
    rng = np.random.default_rng(5)
    vocab = ["idiot", "fool", "kill", "hurt", "you", "they", "not", "never", "said", "wrote"] + ["word"] * 10
    weight = {"idiot": 5.0, "fool": 2.5}
    texts = [" ".join(rng.choice(vocab, rng.integers(1, 16))) for _ in range(400)]
    for t in texts:
        assert toxicity.clause_score(t.split(), weight) == pytest.approx(plain_clause(t.split(), weight)), t
    whole = ". ".join(texts)
    scores = [plain_clause(t.split(), weight) for t in texts]
    got = toxicity.features(whole, toxicity.Lexicon(weight, {}))
    assert got == pytest.approx((max(scores), sum(scores), sum(x > 0 for x in scores)))


def test_composition_equals_cascade():
    rng = np.random.default_rng(5)
    machines = (toxicity.NEGATION_RULE, toxicity.TARGET_RULE, toxicity.REPORT_RULE, toxicity.THREAT_RULE, toxicity.INSULT_RULE)
    for _ in range(200):
        symbols = rng.integers(0, 9, rng.integers(1, 15)).tolist()
        got = toxicity.GRAMMAR.run(symbols)
        factors = np.ones(len(symbols))
        for m in machines:
            out = m.run(symbols)
            symbols, factors = [o for o, _ in out], factors * [f for _, f in out]
        assert [o for o, _ in got] == symbols and [f for _, f in got] == pytest.approx(factors.tolist())


def test_toxicity_learns_and_handles_edges(spark):
    rng = np.random.default_rng(7)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(300):
        words = list(rng.choice(vocab, 30))
        toxic = i % 3 == 0
        if toxic:
            for w in rng.choice(["blarg", "snorf", "quib"], 2, replace=False):
                words.insert(int(rng.integers(0, 30)), str(w))
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None), (7, 0)], "doc_id long, toxic int")
    scorer = toxicity.fit(docs, labels)
    assert {"blarg", "snorf", "quib"} <= set(scorer.lexicon.words)
    texts = [None, "", "w1 w2", "blarg w2 snorf", "w3 " * 50_000 + "blarg quib", "w1 w2"]
    got = by_id(toxicity.score(documents(spark, texts), scorer))
    assert [got[i]["predicted"] for i in range(6)] == [0, 0, 0, 1, 1, 0]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[0]["score"] == got[1]["score"] == got[2]["score"]
    empty = toxicity.fit(docs, labels.where("false"))
    assert by_id(toxicity.score(documents(spark, ["you idiot", "fine"]), empty))[0]["score"] > 0.5
    assert toxicity.score(docs.where("false"), scorer).count() == 0


def test_copies_do_not_enter_the_lexicon():
    copied = [toxicity._units("blarg " + "same words in every copy " + "snorf") for _ in range(50)]
    assert len({u["copy"] for u in copied}) == 1


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op4_toxicity(spark, sf).collect() if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in rows) >= 0.97 * len(rows)


def plain_cross_entropy(rows, text, out=None):
    """The formulas with dictionaries; rows: (text, is_target); ``out``: the number of the row that is left out."""
    size = max(1, len({w for t, _ in rows for w in WORDS.findall((t or "").lower())}))
    rows = [r for i, r in enumerate(rows) if i != out]

    def model(texts):
        word, history, pair = {}, {}, {}
        for t in texts:
            before = None
            for w in WORDS.findall((t or "").lower()):
                word[w] = word.get(w, 0) + 1
                history[before] = history.get(before, 0) + 1
                pair[before, w] = pair.get((before, w), 0) + 1
                before = w
        n = sum(word.values())

        def p(before, w):
            unigram = (word.get(w, 0) + lm_scoring.SMOOTHING) / (n + lm_scoring.SMOOTHING * size)
            if before not in history:
                return unigram
            return lm_scoring.INTERPOLATION * pair.get((before, w), 0) / history[before] + (1 - lm_scoring.INTERPOLATION) * unigram

        return p

    target, background = model(t for t, good in rows if good), model(t for t, _ in rows)
    words = WORDS.findall((text or "").lower())
    gaps = [math.log(target(a, b)) - math.log(background(a, b)) for a, b in zip([None, *words], words, strict=False)]
    return sum(gaps) / len(gaps) if gaps else 0.0


def test_lm_scoring_against_plain(spark):
    rng = np.random.default_rng(11)
    rows = [(" ".join(rng.choice(["alpha", "Beta", "gamma", "δ", "e", "f"], rng.integers(0, 12))), bool(i % 3 == 0)) for i in range(40)] + [(None, True), ("", False), ("alpha " * 3000, False), ("alpha Beta", True), ("alpha Beta", True)]
    marked = spark.createDataFrame(rows, "text string, is_target boolean")
    models = lm_scoring.count(marked)
    got = by_id(lm_scoring.score(documents(spark, [t for t, _ in rows]), models))
    for i, (t, _) in enumerate(rows):
        assert got[i]["score"] == pytest.approx(plain_cross_entropy(rows, t), abs=1e-4)
        assert (got[i]["target_loss"] is None) == (got[i]["n_words"] == 0)
    # documents that are counted themselves are scored by the others
    numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, is_target boolean").repartition(3)
    for r in lm_scoring.score_counted(numbered).collect():
        assert r["score"] == pytest.approx(plain_cross_entropy(rows, rows[r["doc_id"]][0], r["doc_id"]), abs=1e-9)
    none = lm_scoring.count(marked.where("false"))
    assert lm_scoring.score(documents(spark, ["alpha"]), none).first()["score"] == 0
    assert lm_scoring.score(documents(spark, ["alpha"]).where("false"), models).count() == 0


def test_lm_scoring_keeps_unrelated_words_apart(spark):
    # more words and pairs than the buckets of any fixed table that a driver would hold: every count stays exact
    many = [" ".join(f"n{i * 2000 + k}" for k in range(2000)) for i in range(300)]
    rows = [(t, False) for t in many] + [("rare one of the target", True), ("rare one of others", False)]
    marked = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, is_target boolean")
    got = by_id(lm_scoring.score_counted(marked))
    # plain counts, with the vocabulary of this corpus
    n_words, n_target, size = 600_000 + 9, 5, 600_000 + 6
    a, share = lm_scoring.SMOOTHING, lm_scoring.INTERPOLATION

    def loss(pairs, n):
        return -sum(math.log(share * two / seen + (1 - share) * (one + a) / (n + a * size) if seen else (one + a) / (n + a * size)) for one, seen, two in pairs) / len(pairs)

    # (count of the word, of its history, of both), less the document's own
    assert got[300]["target_loss"] == pytest.approx(math.log(size))
    assert got[300]["background_loss"] == pytest.approx(loss([(1, 301, 1), (1, 1, 1), (1, 1, 1), (0, 1, 0), (0, 0, 0)], n_words - 5))
    assert got[301]["target_loss"] == pytest.approx(loss([(1, 1, 1)] * 3 + [(0, 1, 0)], n_target))
    assert got[0]["background_loss"] == pytest.approx(loss([(0, 301, 0)] + [(0, 0, 0)] * 1999, n_words - 2000))


def test_lm_scoring_over_many_chunks(spark, monkeypatch):
    """More chunks than those from which on there are more parts: the same scores."""
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(f"w{int(k)}" for k in rng.exponential(30, rng.integers(0, 40))), bool(i % 4 == 0)) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, is_target boolean")
    want = by_id(lm_scoring.score_counted(frame))
    monkeypatch.setattr(lm_scoring, "CHUNK", 100)
    monkeypatch.setattr(lm_scoring, "PART_BITS", 1)
    monkeypatch.setattr(lm_scoring, "PART_CHUNKS", 16)
    got = by_id(lm_scoring.score_counted(frame))
    assert {i: (r["n_words"], r["score"] and round(r["score"], 9)) for i, r in got.items()} == {i: (r["n_words"], r["score"] and round(r["score"], 9)) for i, r in want.items()}
