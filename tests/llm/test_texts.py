"""Chat formatting, page text, mixing, line dedup, toxicity, and the pipeline."""

import random
import time

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from roadlens.llm import chat, html_text, line_dedup, mixing, queries, toxicity


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def duck(documents):
    con = duckdb.connect()
    con.register("documents", documents.toPandas())
    con.execute("CREATE VIEW d2 AS SELECT * FROM documents")
    return con


# --- chat

TALK = [
    (1, 0, "system", "be kind"),
    (1, 1, "user", "hi </s> \\ [INST] \\[INST]"),
    (1, 2, "assistant", "<<s>[/INST]</s\n> é 🎉"),
    (1, 3, "assistant", None),
    (2, 0, None, "x"),
    (2, 0, "user", "[ROLE]"),
    (3, None, "user", ""),
    (None, 1, "assistant", "lost"),
    (-7, 0, "user", "</s>[INST] ok [/INST]"),
    (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
]


def written_turn(role, text):
    if role == "user":
        return f"[INST]{text}[/INST]"
    return f"{text}</s>" if role == "assistant" else f"[ROLE]{chat.escape(role)}[/ROLE]{text}</s>"


def test_round_trip(spark):
    df = spark.createDataFrame([(*t, 1) for t in TALK], "conv_id long, turn int, role string, text string, size int")
    want = []
    for conv in {t[0] for t in TALK}:
        turns = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in TALK if t[0] == conv))
        learnt = "".join(t[3] for t in turns if t[2] == "assistant")
        written = "<s>" + "".join(written_turn(t[2], chat.escape(t[3])) for t in turns)
        want.append((conv, len(turns), brute.sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(learnt), brute.sha(learnt), len(written)))
    assert rows(chat.round_trip(df)) == sorted(want, key=str)
    assert rows(chat.round_trip(df.limit(0))) == []


def test_stream(spark, monkeypatch):
    """A conversation is one stream of ids, wherever its pieces are cut."""
    monkeypatch.setattr(chat, "PIECE", 4)
    df = spark.createDataFrame([(1, k, ("user", "assistant")[k % 2], f"word {k} " * k) for k in range(9)], "conv_id long, turn int, role string, text string")
    form = chat.Formatter(chat.vocabulary(chat.VOCABULARY))
    found = chat.conversation_stream(df).orderBy("piece").collect()
    ids, mask = ([x for r in found for x in r[c]] for c in ("ids", "mask"))
    assert ids.count(form.reserved + chat.BOS) == 1 and ids[0] == form.reserved + chat.BOS and len(ids) == len(mask)
    told = set()
    for step in (1, 3, 1000):
        reader = chat.Reader(form)
        for k in range(0, len(ids), step):
            reader.feed(np.array(ids[k : k + step], np.int32), np.array(mask[k : k + step], np.int8))
        told.add(reader.row())
    assert told == {tuple(rows(chat.round_trip(df))[0][1:])}


@pytest.mark.parametrize("text", ["", "\\", "\\\\", "<s>", "</s>", "<\\/s>", "[[INST]", "[/ROLE][ROLE", "a\\[INST]b"])
def test_escape(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROL)


def test_mask_by_tokens(spark):
    out = {(r["conv_id"], r["turn"]): r for r in chat.formatted_turns(spark.createDataFrame(TALK, "conv_id long, turn int, role string, text string")).collect()}
    assert sum(out[1, 1]["mask"]) == 0 and all(out[1, 2]["mask"]) and len(out[1, 3]["mask"]) == 1


# --- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header>Site</header><nav><ul><li>Home</li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head&nbsp;line &amp; more</h1><p>First  <b>bold</b>
text.<br>After<p>Second <script>var a="<p>no</p>"</script>one<aside>Side</aside><form><input>Form</form><table><tr><td>cell</td></tr></table></article>
<div id="comments"><p>Reader</p></div><footer>Foot</footer></body>"""


def test_page():
    assert html_text.main_text(PAGE) == "Head line & more\nFirst bold text. After\nSecond one\ncell"


def test_page_without_article():
    long = "Word " * 60
    html = f"<div class=menu><a>x</a></div><div><p>{long}</p><p>Hm.</p><p>{long}</p></div><div class='ad'>Buy</div>"
    assert html_text.main_text(html) == "\n".join([long.strip(), "Hm.", long.strip()])


PROSE = "Word by word it goes. " * 20
KEPT = PROSE.strip()
LINK_LIST = "<ul><li><a href=a>Share it</a></li><li><a href=b>Tell us</a></li><li><a href=c>Mail</a></li></ul>"


@pytest.mark.parametrize(
    "html, text",
    [
        # names only tip it: a wrapper, and prose inside an article
        (f"<div class=widget-content><article><h1>T</h1><p>{PROSE}</p></article></div><p>Other</p>", f"T\n{KEPT}"),
        (f"<div class=widget-content><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p></div><p>© 2020</p>", f"T\n{KEPT}\n{KEPT}"),
        (f"<article><h1>T</h1><p>{PROSE}</p><div class=social-text><p>{PROSE}</p></div></article>", f"T\n{KEPT}\n{KEPT}"),
        # chrome without a name
        (f"<article><p>{PROSE}</p>{LINK_LIST}<p>end</p></article>", f"{KEPT}\nend"),
        (f"<div>{LINK_LIST}</div><div><h1>T</h1><p>{PROSE}</p><p>Hm.</p><p>{PROSE}</p></div><div>© 2020 <a href=x>Imprint</a></div>", f"T\n{KEPT}\nHm.\n{KEPT}"),
        # comments outweigh the article; an article in two parts; a teaser
        (f"<article><h1>T</h1><p>{PROSE}</p></article><div id=comments>{f'<article><p>{PROSE}</p></article>' * 5}</div>", f"T\n{KEPT}"),
        (f"<h1>Title</h1><article><p>{PROSE * 3}</p></article><article><p>{PROSE}</p></article>", f"Title\n{(PROSE * 3).strip()}\n{KEPT}"),
        (f"<article><p>{PROSE * 3}</p></article><article><h2><a href=y>More</a></h2><p>{PROSE}</p></article>", (PROSE * 3).strip()),
    ],
)
def test_ratio_decides(html, text):
    assert html_text.main_text(html) == text


def test_generated_pages():
    """Whatever chrome stands around an article, named or not, what is between is returned."""
    rng = random.Random(5)
    chrome = ["<nav>{}</nav>", "<div class=menu>{}</div>", "<div>{}</div>", "<footer>{}</footer>", "<aside><p>{}</p></aside>", "<div id=sidebar>{}</div>"]
    for _ in range(200):
        blocks = [" ".join(rng.choice(("lorem", "ipsum", "dolor", "sit")) for _ in range(rng.randint(30, 90))) for _ in range(rng.randint(2, 6))]
        body = "".join(f"<p>{b.replace('dolor', '<b>dolor</b>')}</p>" for b in blocks)
        wrap = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div class=widget-area>{}</div>", "<div>{}</div>"])
        around = ["".join(rng.choice(chrome).format(LINK_LIST) for _ in range(rng.randint(0, 3))) for _ in range(2)]
        assert html_text.main_text(f"<body>{around[0]}{wrap.format(body)}{around[1]}</body>") == "\n".join(blocks)


def test_many_tags():
    for html in ("<b>" * 100_000 + "</i>" * 100_000, "<div class=ad>x" * 20_000, "<article>x</article>" * 20_000):
        start = time.perf_counter()
        html_text.main_text(html)
        assert time.perf_counter() - start < 5


@pytest.mark.parametrize("html, text", [("", ""), ("plain", "plain"), ("<p", ""), ("<article><p>open", "open"), ("<nav>only</nav>", "")])
def test_odd_pages(html, text):
    assert html_text.main_text(html) == text


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 1), (None, None, None, 2), (1, "u", "", 3)], "page_id long, url string, html string, text int")
    assert [(r["page_id"], r["n_chars"]) for r in html_text.extracted(df).orderBy("n_chars", F.desc_nulls_last("page_id")).collect()] == [(1, 0), (None, 0), (1, 55)]


def test_end_tags_without_beginning():
    start = time.perf_counter()
    assert html_text.main_text("<div>" * 30_000 + "</span>" * 100_000 + "text") == "text"
    assert time.perf_counter() - start < 10


# --- mixing

def test_mix_as_in_sql(documents, duck):
    assert rows(mixing.report(documents)) == sorted(duck.execute(mixing.ORACLE_SQL).fetchall(), key=str)


def test_targets(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, "d": 0, None: 500}
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    # weights 5 2 1 5 2 in order a b c d null; filled by hand until nothing is above three times
    weights, left, total, want = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, set(sizes), float(sum(sizes.values())), {}
    while True:
        share = {s: total * weights[s] / sum(weights[x] for x in left) for s in left}
        full = {s for s in left if share[s] > 3 * sizes[s]}
        if not full:
            break
        want |= {s: 3.0 * sizes[s] for s in full}
        total -= sum(3 * sizes[s] for s in full)
        left -= full
    assert got == pytest.approx(want | share)


def test_mix_comes_near(spark):
    rng = random.Random(1)
    docs = [(i, "w " * int(rng.paretovariate(1) * 20), f"s{i % 4}") for i in range(4000)]
    out = mixing.mixed(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert all(0 <= r["copies"] <= 3 for r in out)
    for s in {r["source"] for r in out}:
        own = [r for r in out if r["source"] == s]
        assert sum(r["copies"] * r["size"] for r in own) == pytest.approx(own[0]["target"], rel=0.01)


def test_mix_odd(spark, empty):
    docs = spark.createDataFrame([(None, None, None), (1, "", "a"), (1, "", "a")], "doc_id long, text string, source string")
    assert [r["copies"] for r in mixing.mixed(docs).collect()] == [0, 0, 0]
    assert mixing.mixed(empty).count() == 0


def test_taken_by_row(spark):
    rng = random.Random(2)
    docs = [((None, 5, i)[i % 3], "w " * int(rng.paretovariate(1) * 20 if i % 5 else 20), f"s{i % 4}", "z") for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, _id string")
    out = mixing.taken(df)
    assert set(out.columns) == {*df.columns, "_copies"}
    got = rows(out.selectExpr("doc_id", "source", "size(split(trim(text), ' '))", "_copies"))
    assert got == rows(mixing.mixed(df).filter("copies > 0").select("doc_id", "source", F.col("size").cast("int"), "copies"))


# --- lines

def lines(spark):
    long = " ".join(f"w{i}" for i in range(60))
    texts = {1: "a\nb\nc\nd", 2: "x\na\n\nb\nc\ny", 3: "a\nb", 4: long, 5: f"p\n{long}\nq", 6: "a\nb\nc\na\nb\nc", 7: None, 8: "", 9: "\n\n"}
    return texts, spark.createDataFrame([(d, t, d, "z") for d, t in texts.items()], "doc_id long, text string, _lines long, _own string")


def test_lines(spark):
    texts, df = lines(spark)
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(df).collect()}
    assert got == texts | {2: "x\n\ny", 5: "p\nq", 6: ""}
    assert {r["doc_id"] for r in line_dedup.cleaned(df).collect()} == set(texts) - {6}
    assert set(line_dedup.cleaned(df).columns) == set(df.columns)


def test_lines_as_in_sql(documents, duck):
    assert rows(line_dedup.digest(documents)) == sorted(duck.execute(line_dedup.ORACLE_SQL).fetchall(), key=str)


def test_lines_odd(spark, empty):
    text = "a\nb\nc"
    df = spark.createDataFrame([(None, text), (2, text), (2, text)], "doc_id long, text string")
    assert rows(line_dedup.deduplicated(df).select("doc_id", "_n_removed")) == [(2, 0), (2, 0), (None, 3)]
    assert line_dedup.digest(empty).count() == 0


def test_passage_on_two_lines(spark):
    half = [" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 45), ("b", 45), ("c", 60), ("d", 4), ("e", 45))]
    texts = {1: half[:2], 2: ["x", *half[:2], "y"], 3: half[1:3], 4: [*half[1:3], "z"], 5: [half[3], half[4]], 6: [half[3], half[4], "q"], 7: half[:2]}
    df = spark.createDataFrame([(d, "\n".join(t)) for d, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.cleaned(df).collect()}
    assert got == {1: texts[1], 2: ["x", "y"], 3: texts[3], 4: ["z"], 5: texts[5], 6: texts[6]}


# --- toxicity

@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    common, bad = [f"{a}{b}" for a in "bcdfgl" for b in ("an", "ering", "ost", "ully")], ["idiot", "worthless", "scumbag", "pathetic"]
    docs, labels = [], []
    for i in range(900):
        w = [rng.choice(common) for _ in range(rng.randint(20, 200))]
        toxic = i % 6 == 0
        for _ in range(rng.randint(2, 5) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((i, " ".join(w), i % 2, 1.0))
        labels.append((i, int(toxic)))
    docs += [(5000, None, 0, 1.0), (5001, "", 0, 1.0), (None, "an idiot", 0, 1.0)]
    return spark.createDataFrame(docs, "doc_id long, text string, toxic int, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(labelled):
    docs, labels = labelled
    out = toxicity.scored(docs, labels).join(labels, "doc_id", "left").collect()
    held = [r for r in out if r["held_out"] and r["toxic"] is not None]
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out) and len(out) == docs.count()
    assert toxicity.accepted(docs, labels).columns == docs.columns


def test_accepted_by_row(spark, labelled):
    docs, labels = labelled
    scores = toxicity.scored(docs, labels).join(docs.select("doc_id", "text"), "doc_id")
    bad, good = (scores.filter(f"predicted = {y} and text <> ''").first()["text"] for y in (1, 0))
    odd = spark.createDataFrame([(None, bad), (None, good), (9999, bad), (9999, good), (9999, good), (None, None)], "doc_id long, text string").selectExpr("*", "0 as toxic", "1e0 as score")
    got = toxicity.accepted(docs.unionByName(odd), labels).filter("doc_id is null or doc_id = 9999").select("doc_id", "text").collect()
    kept = sorted(map(tuple, got), key=str)
    assert kept.count((9999, good)) == 2 and (None, good) in kept and (None, None) in kept and bad not in {t for _, t in kept}


def test_labels_that_contradict_or_repeat(spark, labelled):
    docs, labels = labelled
    want = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, labels).collect()}
    both = labels.unionAll(labels).unionAll(spark.createDataFrame([(5001, 0), (5001, 1), (None, 1), (5000, None)], "doc_id long, toxic int"))
    assert {r["doc_id"]: r["score"] for r in toxicity.scored(docs, both).collect()} == want


def test_only_the_text_counts(spark, labelled):
    docs, labels = labelled
    want = sorted((r["doc_id"] or -1, r["score"]) for r in toxicity.scored(docs, labels).collect())
    other = docs.selectExpr("doc_id", "text", "1 - toxic as toxic", "'x' as lang", "'toxic' as source")
    assert sorted((r["doc_id"] or -1, r["score"]) for r in toxicity.scored(other, labels).collect()) == want


def test_long_text_is_read_to_its_end(spark, labelled):
    docs, labels = labelled
    dull = docs.join(labels, "doc_id").filter(labels["toxic"] == 0).limit(60).agg(F.concat_ws(" ", F.collect_list("text")).alias("t")).first()["t"] * 5
    more = docs.unionByName(spark.createDataFrame([(7000, dull), (7001, dull + " idiot worthless scumbag pathetic idiot")], "doc_id long, text string").selectExpr("*", "0 as toxic", "1e0 as score"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scored(more, labels).filter("doc_id >= 7000").collect()}
    assert got == {7000: 0, 7001: 1}


def test_nothing_to_learn_from(labelled):
    docs, labels = labelled
    assert toxicity.scored(docs, labels.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.scored(docs.limit(0), labels).count() == 0


# --- pipeline and queries

def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, data).cache()
        assert 0 < after.count() <= before.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert dict(after.dtypes) == dict(docs.dtypes)
        before = after
    got = sorted(map(tuple, corpus_pipeline.run(spark, data).select(*before.columns).collect()), key=str)
    assert got == sorted(map(tuple, before.collect()), key=str)


def test_one_query_for_each():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
