"""Operators against plain versions, on shared tables and on edge cases."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import prose
from veritab.llm import (
    op1_mixing,
    op2_decontamination,
    op3_substring_dedup,
    op4_suffix_tree,
    op5_line_dedup,
    op6_license_scan,
    op7_simhash,
    op8_html_text,
    op9_quality,
    op10_suffix_dedup,
)


def removed():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


LINES = ["doc_id", "__n_lines", "__n_dropped"]
BASE = ["doc_id", *[f"__{m}" for m in op9_quality.MEASURES], "__base_failed"]

DIGESTS = {
    "passages": lambda d: op3_substring_dedup.remove_repeats(d).select("doc_id", "n_words", removed(), F.sha2("kept_text", 256)),
    "byte_repeats": lambda d: op10_suffix_dedup.remove_repeated_bytes(d).select("doc_id", "n_bytes", removed(), F.size("spans"), F.sha2("kept", 256)),
    "common_lines": lambda d: op5_line_dedup.mark_common_lines(d).select(*LINES, F.sha2("__kept", 256)),
    "simhash": lambda d: op7_simhash.simhash_components(d),
    "quality": lambda d: op9_quality.mark_quality(d).select(*BASE),
    "base_scores": lambda d: op4_suffix_tree.score_documents(d).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6)
    ),
}


bag_of = Counter


def bag(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", sorted(DIGESTS))
def test_edge_cases(edges, edge_rows, name):
    assert bag(DIGESTS[name](edges)) == getattr(brute, name)(edge_rows)


@pytest.mark.parametrize("name", sorted(DIGESTS))
def test_documents(documents, document_rows, name):
    assert bag(DIGESTS[name](documents)) == getattr(brute, name)(document_rows)


@pytest.mark.parametrize("name", sorted(DIGESTS))
def test_empty_table(nothing, name):
    assert DIGESTS[name](nothing).count() == 0


@pytest.mark.parametrize("operator", [
    op1_mixing.mix, op5_line_dedup.drop_common_lines, op7_simhash.drop_near_copies, op9_quality.keep_good, op6_license_scan.scan,
])
def test_empty_table_of_filters(nothing, operator):
    assert operator(nothing).count() == 0


@pytest.mark.parametrize("operator", [op5_line_dedup.drop_common_lines, op7_simhash.drop_near_copies, op9_quality.keep_good])
def test_filters_keep_columns(edges, operator):
    out = operator(edges)
    assert out.columns == edges.columns and out.count() > 0


def items(spark, *rows):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def test_contained_items(spark, edges, edge_rows):
    known = dict(edge_rows)
    rows = [(1, known[7]), (2, " ".join(known[1].split()[20:60])), (3, "nothing of this kind is there"), (4, None), (5, ""), (6, "one"), (6, "one"),
            (7, " ".join([*known[5].split()[10:40], "unlike", "words"])), (8, "A, shared! LINE (of) text")]
    found = op2_decontamination.contained_items(edges, items(spark, *rows))
    assert bag(found) == brute.contained(edge_rows, rows)
    clean = op2_decontamination.drop_contaminated(edges, items(spark, *rows))
    assert clean.columns == edges.columns
    expected = Counter(row for row in edge_rows if not brute.contained([row], rows))
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == expected
    none = items(spark)
    assert op2_decontamination.contained_items(edges, none).count() == 0
    assert op2_decontamination.drop_contaminated(edges, none).count() == len(edge_rows)
    assert op2_decontamination.contained_items(edges.limit(0), items(spark, *rows)).count() == 0


def test_contained_items_in_blocks(monkeypatch, spark, documents, document_rows):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    expected = brute.contained(document_rows, [tuple(r) for r in benchmark.collect()])
    assert bag(op2_decontamination.contained_items(documents, benchmark)) == expected
    monkeypatch.setattr(op2_decontamination, "BLOCK_BYTES", 2000)
    assert bag(op2_decontamination.contained_items(documents, benchmark)) == expected


def test_mixing(edges, edge_rows):
    rows = op1_mixing.mix(edges).collect()
    assert len(rows) == len(edge_rows)
    total = sum(len(brute.words(t)) for _, t in edge_rows)
    targets = {(r.source is None, r.source): (r.target, r.source_size) for r in rows}
    assert sum(t for t, _ in targets.values()) == pytest.approx(total)
    assert all(t <= 3 * s + 1e-6 for t, s in targets.values())
    assert all(r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in rows)
    assert sum(r.taken for r in rows) <= total
    again = op1_mixing.mix(edges.repartition(5)).select("doc_id", "source", "size", "taken")
    assert bag(again) == Counter((r.doc_id, r.source, r.size, r.taken) for r in rows)


def test_mixing_targets_stop_at_three_times_the_source(spark):
    sizes = spark.createDataFrame([(False, "a", 10), (False, "b", 1000), (False, "c", 500), (True, "", 90)], "__none boolean, __from string, __source_size long")
    got = {(r["__none"], r["__from"]): r["__target"] for r in op1_mixing.source_targets(sizes).collect()}
    # weights 5 2 1 5: a and the null source are capped, the rest is shared 2 : 1
    assert got[False, "a"] == 30 and got[True, ""] == 270
    assert got[False, "b"] == pytest.approx(1300 * 2 / 3) and got[False, "c"] == pytest.approx(1300 / 3)


def test_mixing_without_words(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r.size, r.target, r.taken) for r in op1_mixing.mix(docs).collect()} == {(0, 0.0, 0)}


def test_scores_beat_the_base_on_held_out_documents(spark):
    scores = op4_suffix_tree.op4_suffix_tree(spark, "/root/testdata/sf0.1").filter("held_out")
    score, base = scores.agg(F.sum("score"), F.sum("base_score")).first()
    assert score > base + 0.02 * abs(base)


LIMITS = [op4_suffix_tree.DEPTH, op4_suffix_tree.MIN_COUNT, op4_suffix_tree.MIN_DIVERGENCE, op4_suffix_tree.Z]


def test_tree_scores_equal_the_plain_version(spark, edges, edge_rows, document_rows):
    text = "the cat sat on the mat the cat ran to the mat as we see one red old big fish and two red old big birds "
    rows = edge_rows + document_rows + [(1000 + k, text * (1 + k % 7)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = bag_of((r.doc_id, round(r.score, 4)) for r in op4_suffix_tree.score_documents(docs).collect())
    assert {len(c) for c in brute.trained_tree(rows, *LIMITS)[2]} == set(range(1, op4_suffix_tree.DEPTH + 1))
    assert got == brute.tree_scores(rows, *LIMITS)


def test_contexts_grow_with_the_corpus(spark, document_rows):
    larger = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    few, many = (len(brute.trained_tree(rows, *LIMITS)[2]) for rows in (document_rows, larger))
    assert many > 2 * few > 0


def test_license_scan(spark, edges):
    notices = [(1, "x\n MIT is fine\nReleased under the mit license"), (2, dict(enumerate(op6_license_scan.TEMPLATES))[5][1].replace(" ", "\n")),
               (3, None), (4, ""), (5, "under the license"), (6, "intro\n\n" + op6_license_scan.TEMPLATES[3][1] + "\n\nend"), (6, "a"), (7, "word")]
    docs = spark.createDataFrame(notices, "doc_id long, text string")
    got = {(r.doc_id, r.licence): (round(r.dice, 3), r.unit) for r in op6_license_scan.scan(docs).collect()}
    assert got[1, "MIT"] == (1.0, "line") and got[2, "Apache-2.0"] == (1.0, "paragraph") and got[6, "MIT"] == (1.0, "line")
    assert {i for i, _ in got} == {1, 2, 6}
    assert op6_license_scan.scan(edges).count() == 0


def test_license_scan_keeps_rows_of_one_id_apart(spark):
    notice, other = "Released under the MIT license", "some other words that are long enough to be no part of a notice"
    notices = [(1, f"{notice}\n{other}"), (1, f"{other}\n{notice}"), (1, f"{other}\n{notice}"), (None, notice), (None, f"{other}\n{notice}")]
    got = op6_license_scan.scan(spark.createDataFrame(notices, "doc_id long, text string")).collect()
    assert bag_of((r.doc_id, r.licence, r.place, r.n_units) for r in got) == bag_of([(1, "MIT", 0, 1), (1, "MIT", 1, 1), (None, "MIT", 0, 1), (None, "MIT", 1, 1)])


WORKING = ["__slot", "__SIZE", "__none", "__from", "__order", "__id", "__line", "__lines", "__drop", "__kept", "__quality", "__turn", "held_0"]


@pytest.mark.parametrize("stage", range(5))
def test_columns_named_like_working_columns_survive(spark, edges, stage):
    import corpus_pipeline

    named = edges.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(c), F.coalesce("doc_id", F.lit(-1))).alias(c) for c in WORKING])
    function = corpus_pipeline.STAGES[stage][1]
    got = function(spark, named, "/root/testdata/sf0.001")
    assert [c for c in got.columns if c in named.columns] == named.columns
    rows = got.collect()
    assert rows and all(r[c] == f"{c}{-1 if r.doc_id is None else r.doc_id}" for r in rows for c in WORKING)
    assert bag_of(r.doc_id for r in rows) == bag_of(r.doc_id for r in function(spark, edges, "/root/testdata/sf0.001").collect())


QUOTES = [
    ("<p title=it's>First one isn't short at all.</p><p>Second one isn't either, by far.</p><p>Third one, a last paragraph of words.", 3),
    ("<p title=\"a>b\" class='x>y'>First one is not short at all.</p><p data-x = 'q>r'>Second one is not either, by far.</p>", 2),
    ("<p title=\"open>First one is not short at all.</p><p it's>Second one isn't either, by far.</p>", 2),
]


@pytest.mark.parametrize("page, count", QUOTES)
def test_quotes_open_values_after_equals_only(page, count):
    text = op8_html_text.main_text(page)
    assert len(text.split("\n\n")) == count and text.startswith("First") and ">" not in text


@pytest.mark.parametrize("tag", ["div", "p", "b", "li", "a"])
def test_deep_and_long_pages_in_linear_time(tag):
    import time

    body = "A sentence of plain words for this page. "
    deep = "".join(f"<{tag}>{body}" for _ in range(50_000))
    flat = "".join(f"<{tag}>{body}</{tag}>" for _ in range(50_000))
    started = time.process_time()
    assert op8_html_text.read_blocks(deep + f"</{tag}>" * 50_000) and op8_html_text.read_blocks(flat + "</i>" * 50_000)
    assert time.process_time() - started < 20


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site to make it better for you and for us.</p></div>
<main><article><h1>The &amp; title</h1><p>First<br>
 paragraph <b>bold</b><p>Second <script>var t="</p>";</script>one.<form><input name=q><label>Search</label></form>
<div id="comments"><p>Nice article, thank you very much, I enjoyed all of it a lot!</p></div></article></main>
<aside><p>Something else entirely that readers of this page may also like to read.</p></aside><footer>&copy; us</footer></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, None, None, 2), (3, "v", "", 3), (4, "w", "plain &lt; text", 4), (None, "x", "<p>Open <b>bold", 5)],
                                  "page_id long, url string, html string, text int")
    got = op8_html_text.extract_text(pages).collect()
    assert len(got) == 6 and {r.text for r in got if r.page_id == 1} == {"The & title\n\nFirst paragraph bold\n\nSecond one."}
    assert {r.page_id: r.text for r in got if r.page_id != 1} == {2: "", 3: "", 4: "plain < text", None: "Open bold"}
    assert op8_html_text.extract_text(pages.limit(0)).count() == 0


def test_html_cut_smooths():
    """A short paragraph between long ones stays; without the edges its own cost would drop it."""
    long = "prose with a fair number of words in a sentence " * 5
    page = f"<div><div>{long}</div><div>A few</div><div>{long}</div></div>"
    short = op8_html_text.read_blocks(page)[1]
    assert op8_html_text.content_cost(short, False) < 0 and "A few" in op8_html_text.main_text(page)


def test_html_cut_is_minimal():
    """The cut's weight equals the best of all labellings of a small page."""
    from itertools import product

    page = "<div>a b c <a>d e f</a></div><div><p>some words here</p><ul><li>x<li><a>y</a></ul></div><p>more words in the end of it</p>"
    blocks = op8_html_text.read_blocks(page)
    costs = [op8_html_text.content_cost(b, False) for b in blocks]
    pairs, under = [], {}
    for k, b in enumerate(blocks):
        if k:
            pairs.append((k - 1, k, op8_html_text.ADJACENT / (1 + op8_html_text.tree_distance(blocks[k - 1].element, b.element))))
        parent = id(b.element.parent)
        if under.get(parent, k - 1) < k - 1:
            pairs.append((under[parent], k, op8_html_text.SIBLING))
        under[parent] = k
    weight = lambda keep: sum(max(c, 0) * (not x) + max(-c, 0) * x for c, x in zip(costs, keep)) + sum(w for a, b, w in pairs if keep[a] != keep[b])
    text = op8_html_text.main_text(page)
    chosen = [b.text in text.split("\n\n") for b in blocks]
    assert weight(chosen) == pytest.approx(min(weight(k) for k in product([False, True], repeat=len(blocks))))


def test_quality_verdicts_follow_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = op9_quality.mark_quality(docs).filter("NOT __base_failed").join(labels, "doc_id").groupBy("quality", "__kept").count().collect()
    n = {(r.quality, r["__kept"]): r["count"] for r in rows}
    assert n.get((1, False), 0) <= 0.005 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]


def test_quality_keeps_a_clean_corpus(spark):
    docs = spark.createDataFrame([(k, prose(k, 60 + 7 * k)) for k in range(150)], "doc_id long, text string")
    assert op9_quality.keep_good(docs).count() == 150


def test_crowded_fingerprint_buckets(monkeypatch, spark):
    """Links do not depend on the bucket bound, down to no equality join at all."""
    import random

    rng, centre = random.Random(3), 0x123456789ABCDEF
    prints = sorted({centre ^ sum(1 << rng.randrange(48) for _ in range(rng.randint(0, 4))) for _ in range(300)})
    nodes = spark.createDataFrame([(p,) for p in prints], "hi long")
    from veritab.llm.components import components

    expected = brute.groups(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    for bound in (0, 8, 10_000):
        monkeypatch.setattr(op7_simhash, "BUCKET", bound)
        links = op7_simhash.fingerprint_links(nodes)
        assert all((r.l.hi ^ r.r.hi).bit_count() <= 2 for r in links.collect())
        roots = {r.node: r.root for r in components(links.select(F.col("l.hi").alias("a"), F.col("r.hi").alias("b"))).collect()}
        assert [roots.get(p, p) for p in prints] == [prints[r] for r in expected]


def test_near_copy_stage(spark):
    base = prose(1, 300).split()
    edit = lambda seed: " ".join([*base[: 20 * seed], f"edit{seed}", *base[20 * seed + 1 :]])
    rows = [(k, edit(k)) for k in range(1, 12)] + [(100, " ".join(base)), (101, " ".join(base))] + [(200 + k, prose(200 + k, 300)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in op7_simhash.drop_near_copies(docs).collect()}
    assert {200 + k for k in range(40)} <= kept and 101 not in kept and len(kept) <= 42


def alike_texts(seed, apart, count=200):
    """Two texts of `count` shingles each, of which the last `apart` differ."""
    common = prose(seed, count + 4 - apart)
    return f"{common} {prose(seed + 10_000, apart)}", f"{common} {prose(seed + 20_000, apart)}", (count - apart) / (count + apart)


def test_near_copy_line(spark):
    """Pairs planted below, at and above the line: a Jaccard similarity of 0.8 decides each."""
    wanted, rows = {}, []
    for k, apart in enumerate([40, 28, 24, 23, 22, 21, 16, 15, 10, 9] * 12):
        a, b, similarity = alike_texts(1000 + k, apart, 198)
        assert abs(brute.jaccard(a, b) - similarity) < 1e-12
        wanted[2 * k + 1] = similarity < 0.8
        rows += [(2 * k, a), (2 * k + 1, b)]
    kept = {r.doc_id for r in op7_simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {2 * k for k in range(len(rows) // 2)} | {k for k, stays in wanted.items() if stays}


@pytest.mark.parametrize("bucket, common", [(0, 2), (2, 10**9), (10**9, 4)])
def test_near_copy_families(monkeypatch, spark, bucket, common):
    """Chains, families of about 0.7 and shared passages, at any bound of the buckets and any order of shingles."""
    import random

    monkeypatch.setattr(op7_simhash, "SET_BUCKET", bucket)
    monkeypatch.setattr(op7_simhash, "SAMPLE_COUNT", common)
    rng, texts, passage = random.Random(5), [], prose(77, 40)
    for family in range(4):
        text = prose(500 + family, 120).split()
        for step in range(14):
            texts.append(" ".join(text))
            at = rng.randrange(100)
            changed = [*text[:at], *prose(rng.randrange(10**6), 3 + 5 * (family % 2)).split(), *text[at + 3 + 5 * (family % 2) :]]
            text = changed if family < 2 or step == 0 else text[:40] + prose(rng.randrange(10**6), 20).split() + text[60:]
    texts += [f"{passage} {prose(900 + k, 15)}" for k in range(20)] + [texts[0], "", "one two", "one two", "ONE two three four five"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    kept = {r.doc_id for r in op7_simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(brute.groups(texts, lambda a, b: brute.jaccard(a, b) >= 0.8))


def test_components_of_long_paths(spark):
    from veritab.llm.components import components

    links = spark.createDataFrame([(k, k + 1) for k in range(-60, 60) if k != 10], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {k: -60 if k <= 10 else 11 for k in range(-60, 61)}
    assert components(links.limit(0)).count() == 0


def test_near_copies_start_from_fingerprints(monkeypatch, spark):
    """Sets whose fingerprints are near form families before any key is joined, and pairs are formed only between families."""
    nodes = spark.createDataFrame([(5, 0), (3, 0), (9, 3), (2, 1 << 40), (7, -1), (8, -1)], "id long, hi long")
    from veritab.llm.components import components

    roots = {r.node: r.root for r in components(op7_simhash.simhash_pairs(nodes)).collect()}
    assert roots == {2: 2, 3: 2, 5: 2, 9: 2, 7: 7, 8: 7}
    seen, formed, real = [], [], op7_simhash.set_pairs
    monkeypatch.setattr(op7_simhash, "simhash_pairs", lambda n, of=op7_simhash.simhash_pairs: seen.append(n) or of(n))
    monkeypatch.setattr(op7_simhash, "set_pairs", lambda *a: formed.append(real(*a)) or formed[-1])
    long = prose(3, 3000).split()
    rows = [(k, " ".join([*long[: 200 * k], f"edit{k}", *long[200 * k + 1 :]])) for k in range(1, 9)] + [(50, prose(4, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in op7_simhash.drop_near_copies(docs).collect()} == {1, 50}
    sets = [op7_simhash.shingle_set(t.encode(), 5) for _, t in rows[:-1]]
    prints = [op7_simhash.set_print(s) for s in sets]
    families = set(brute.groups(prints, lambda a, b: (a ^ b).bit_count() <= 2))
    assert len(seen) == 1 and len(families) < len(rows) - 1
