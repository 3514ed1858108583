import pytest

from mooring.llm import residue as R


def kinds(text):
    return set(R.evidence(text))


@pytest.mark.parametrize(
    "text,kind",
    [
        ("The {{ name }} is 3.", "placeholder"), ("We get ${answer} then.", "placeholder"), ("so {language} it is", "placeholder"), ("[[question]]", "placeholder"), ("a <<topic>> b", "placeholder"),
        ("@@SUBJECT@@ x", "placeholder"), ("__N_STEPS__ y", "placeholder"), ("%TOPIC% z", "placeholder"), ("%(answer)s", "placeholder"), ("[INSERT NAME HERE]", "placeholder"), ("[Your topic] is", "placeholder"),
        ("<your hint goes here>", "placeholder"), ("<GOLD_ANSWER> is", "placeholder"), ("TODO(hint) later", "placeholder"), ("we {% if hint %} go", "placeholder"), ("这是 {{ 变量x }} {reasoning}。", "placeholder"),
        ("Lorem ipsum dolor sit amet elit sed.", "filler"), ("tbd tbd tbd", "filler"), ("xxxxx xxxx xx xxxxxx", "filler"), ("This is a dummy trace, replace before release.", "filler"), ("此处填写推理过程", "filler"),
        ("504 Gateway Time-out", "error"), ('{"error": {"code": 502}}', "error"), ("Error 404: the page is gone", "error"), ("Traceback (most recent call last):", "error"), ("status=413 reason=\"x\"", "error"),
        ("Fehler 503: Der Dienst ist zurzeit nicht erreichbar.", "error"), ("<html><body>x</body></html>", "error"), ("Rate limit reached, retry after 3 s", "error"), ("A good line.\n\nSomething went wrong. Try again later.", "error"),
        ("Verify that you are human to continue.", "check"), ("Your session has expired, please sign in again.", "check"),
        ("Please enable JavaScript.", "scripts"), ("VEUILLEZ ACTIVER JAVASCRIPT POUR CONTINUER.", "scripts"), ("请启用 JavaScript 后继续访问。", "scripts"), ("<noscript>JavaScript must be on.</noscript>", "scripts"),
    ],
)
def test_evidence(text, kind):
    assert kind in kinds(text)


@pytest.mark.parametrize(
    "text",
    [
        None, "", "  \n", "The template tag `{{ hint }}` prints the value.", "```python\nprint(f\"{name}\")\n```", "$$k = \\frac{{12}}{3 + 1}$$", "The set {3, 4} has two elements and [0] is the first.", "In `List<T>` and `<answer>` T is a type.",
        "A server that answers with status 404 tells the client that the resource is missing.", "A 502 from the gateway means the worker failed, so option B is right.", "Le code 429 indique une surcharge, et la question porte sur la durée.",
        "The question is which message a browser shows when JavaScript is off.", "The exercise asks why designers use lorem ipsum as dummy text.", 'The note "TODO: test" in the listing is quoted.', "题目问的是状态码404的含义,也就是页面不存在。",
        "<reason>Step 1: fine.</reason>", "<REASON>fine</REASON>", "x_{2} \\le \\sqrt{3}", "Al dividir 3 entre 4 se ve el error enseguida.", "const a = 1; `${a.id}`", "The tag `{{ hint", "It costs 450 or 500 or 404 cents.",
    ],
)
def test_no_evidence(text):
    assert kinds(text) == set()


def test_stems_are_no_filter_of_their_own():
    """Every text with evidence above passes the cheap test by design; so do they in upper and lower case."""
    for t in ("Please enable JavaScript.", "rate limit reached", "OUT OF MEMORY", "Erreur 404 : introuvable"):
        assert kinds(t) and kinds(t.upper()) and kinds(t.lower())


SCHEMA = "seq bigint, source string, raw_output string, kinds string"


def test_operator_and_boilerplate(spark):
    banner = "Your browser does not support scripting.\n"
    rows = [(i, "a", banner + f"Text {i} is fine.", "x") for i in range(60)] + [(100, "b", banner + "Text.", "x"), (101, None, "{{ x_y }}", "x"), (102, "a", banner + "504 Gateway Time-out", None), (103, "a", None, None), (104, "a", "", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.seq: r.kinds for r in R.residue(df, "seq", "raw_output", "source").collect()}
    assert got == {100: ["scripts"], 101: ["placeholder"], 102: ["error"]}
    everything = R.residue(df, "seq", "raw_output", "source", share=2.0)
    assert everything.count() == 63
    assert R.residue(df.where("false"), "seq", "raw_output", "source").count() == 0


def test_long_text_is_read_whole(spark):
    df = spark.createDataFrame([(1, "a", "word " * 50_000 + "\n\n{{ topic }}")], "seq bigint, source string, raw_output string")
    assert R.residue(df, "seq", "raw_output", "source").count() == 1


LATIN = "Lorem ipsum dolor sit amet, consectetur adipiscing elit."


@pytest.mark.parametrize("text", ["A worked solution for this problem still has to be added, please do not use this record yet.", "We count the stamps. " * 20 + "The rest of the steps is coming soon. So 12 are left.", "We were asked a question about trams. This is placeholder text. They meet at noon.", "The trams meet after 25 minutes on the bridge. " + LATIN + " So the answer is 25 minutes in all cases."])
def test_filler_is_judged_by_the_sentence(text):
    assert kinds(text) == {"filler"}


def test_filler_that_is_the_subject():
    assert kinds("We count the stamps. The exercise asks why placeholder text is used. So 12 are left.") == set()


@pytest.mark.parametrize(
    "text,kind",
    [
        ("Something went wrong while processing your question. Please try again later.", "error"), ("Something went wrong while processing your question.", "error"), ("The task failed, please try again later.", "error"), ("We were asked a question about trams. They meet at noon. Something went wrong. So the answer is 12.", "error"),
        ("This exercise is about trams. Verify that you are human to continue.", "check"), ("The task is to count. Please enable JavaScript.", "scripts"), ("Это вопрос о трамваях. Попробуйте позже.", "error"), ("サーバーに問題が発生しました。しばらくしてからもう一度お試しください。", "error"),
    ],
)
def test_notice_beside_a_word_of_the_subject(text, kind):
    assert kind in kinds(text)


@pytest.mark.parametrize("text", ["They meet at noon. The question is what 'something went wrong' tells the reader. So 12.", "In the exercise a page says: please try again later.", "The task is to explain why the site is down.", "Die Frage lautet, wann der Server nicht erreichbar ist."])
def test_notice_that_is_the_subject(text):
    assert kinds(text) == set()


def test_recurrent_notice_goes_only_beside_other_content(spark):
    """An outage: nothing but the notice, with a line of the page or a code; and the same notice amid traces."""
    notice = "503 Service Unavailable\n"
    for n in (500, 2000):
        rows = [(i, "a", (notice, notice + "<hr>\nnginx", notice + f"Item {i} is full of `x`.", f"Item {i} is fine.")[0 if i < n // 20 else 1 if i < n // 10 else 2 if i < n // 5 else 3], "") for i in range(n)]
        got = sorted(r.seq for r in R.residue(spark.createDataFrame(rows, SCHEMA), "seq", "raw_output", "source").collect())
        assert got == list(range(n // 10))


def test_lines_of_a_text_with_evidence():
    other = lambda t: [x for x in R.lines(t) if not x[0]]
    assert R.lines("All is fine.\nText 7.") == [] == R.lines(None)
    assert len(R.lines("503 Service Unavailable\n\n---\n<reason></reason>")) == 1
    assert len(other("503 Service Unavailable\n```\nx = 1\n```\nThe sum is $$k$$.\n`y`")) == 3
    (_, normal, same), = other("503 Service Unavailable\nText 7.")
    assert R._hash("text #.") == normal and R._hash("text 7.") == same
    # what is counted is what is looked up
    for t in ("503 Service Unavailable\n `x` Text 7. \n\nNo number", "{{ a }} ${b}\n  Ünïcode ΑΣ 0xff  "):
        assert {h for _, *x in R.lines(t) for h in x} <= R.line_hashes(t)


def test_all_lines_are_counted_by_host(spark):
    """Every line a host repeats is its boilerplate, with evidence or not; brute force."""
    import random
    from collections import Counter

    rng = random.Random(3)
    vocabulary = [f"line {chr(97 + i % 26)}{i} of the page" for i in range(60)] + ["Please enable JavaScript.", "Text 1.", "Text 2.", "---"]
    rows = [(rng.choice(["=a", "=b", "null"]), "\n".join(rng.choices(vocabulary, k=rng.randrange(0, 9)))) for _ in range(900)] + [("=a", None), ("=c", ""), ("=d", "once")]
    counts, totals = Counter(), Counter(h for h, _ in rows)
    for h, t in rows:
        counts.update((h, x) for x in (R.line_hashes(t) if t else ()))
    want = {k for k, n in counts.items() if n >= 2 and n >= 0.08 * totals[k[0]]}
    got = R.boilerplate(spark.createDataFrame(rows, "host string, text string").repartition(5), share=0.08)
    assert {(r.host, r.line) for r in got.collect()} == want and 20 < len(want) < len(counts)


def test_subtraction_decides_what_is_found(spark):
    """Planted boilerplate: a footer of one host, which the patterns take for evidence, and the same line once at another host."""
    footer = "Please sign in to continue to the full trace."
    rows = [(i, "a", f"Trace {i}: the trams meet at {i}.\n{footer}", "") for i in range(200)] + [(900, "b", f"They meet at noon.\n{footer}", "")] + [(1000 + i, "b", f"Trace {i} is fine.", "") for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.seq for r in R.residue(df, "seq", "raw_output", "source").collect()] == [900]
    assert R.residue(df, "seq", "raw_output", "source", share=2.0).count() == 201
