"""Quality rules, extraction, sharding, mixing, packing, search and classifier: edge cases and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from terrasift.llm import classifier, html_text, mixing, neighbours, packing, quality_rules, sharding
from terrasift.llm.queries import QUERIES
from terrasift.llm.sql import ORACLE_SQL

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, size long, kept string, shard string, score string, _row int"
TOKENS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \n ", "one word", "the cat sat on the mat. " * 40, "x" * 50_000, "Ä ß 日本 <|endoftext|> don't 12.5% (ok)... a.b, c"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 4}", 1, "k", "s", "c", 2) for i, t in enumerate(TEXTS * 2)]
    return spark.createDataFrame([*rows, rows[4], (None, "no id", None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_base_counts_against_the_plain_rule():
    text = "a b c a b c x\nline one\n\nline one\n \na b c # $ <x>\tend\x0bq"
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    assert quality_rules.base_counts(text) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def test_quality_rules_edge_cases(docs, empty):
    found = quality_rules.apply_rules(docs)
    assert found.count() == docs.count() and found.columns.count("kept") == 1
    assert all(not r.kept and r.base_failed for r in found.where("text IS NULL OR text = ''").collect())
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.apply_rules(empty).count() == 0


def test_references_are_means_over_all_texts(spark):
    # different texts that share their long words, and copies of one of them that differ in case and punctuation
    texts = [f"extraordinary circumstances of item{k} " + "and so on " * (k + 1) for k in range(30)]
    rows = [(k, t, "en") for k, t in enumerate([*texts, texts[3], texts[3].upper(), texts[3].replace(" of ", ", of ")])]
    found, = quality_rules.references(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    places = {w.encode(): k for k, w in enumerate(found.words)}
    want = sum(h / h.sum() for h in (quality_rules.word_histogram(t, places) for t in texts))
    assert found.lang == "=en" and np.allclose(found.by_words, want, atol=1e-5)
    assert round(sum(found.by_classes), 4) == 30 + quality_rules.Limits().prior_docs


def plain_distance(a, b):
    """Jensen-Shannon distance of two dicts of counts, term by term."""
    if not sum(a.values()) or not sum(b.values()):
        return 1.0
    p, q = ({k: v / sum(x.values()) for k, v in x.items()} for x in (a, b))
    m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
    return math.sqrt(max(0.0, sum(x[k] * math.log2(x[k] / m[k]) / 2 for x in (p, q) for k in x if x[k])))


def plain_class(c):
    if c.isspace():
        return "space"
    if c.isupper():
        return "upper"
    if c.isalpha():
        return "letter" if c.isascii() else "other letter"
    return "digit" if c.isdigit() else "mark" if c in ".,;:'\"!?-()" else "rest"


def plain_histogram(text, common):
    out = Counter()
    for w in re.sub(r'[.,;:!?"()]', " ", text.lower()).split():
        out[w if w in common else "-symbol" if not any(c.isalnum() or ord(c) > 127 for c in w) else "-other"] += 1
    return out


def test_distances_and_verdicts_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = {lang: ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 10))) for _ in range(90)] for lang in ("en", "fr", None)}
    rows = []
    for i in range(60):
        lang = rng.choice([*vocabulary, "rare"] if i == 7 else list(vocabulary))
        words = rng.choices(vocabulary.get(lang, ["only"]), [1 / (k + 1) for k in range(len(vocabulary.get(lang, ["only"])))], k=rng.randint(40, 120))
        text = " ".join(rng.choice([w, w.title(), w + ","]) for w in words)
        rows.append((i, text if i % 9 else "".join(rng.choice("#$%^ 0123456789~") for _ in range(400)), lang))
    rows += [(90, rows[1][1].upper(), rows[1][2]), (91, None, "en"), (92, "", None), (93, "!!!", "new")]
    limits = quality_rules.Limits(class_distance=0.2, word_distance=0.3, min_docs=15, main_share=0.3)
    found = {r.doc_id: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), limits).collect()}
    common, words, classes, n = {}, {}, {}, Counter()
    for lang in {r[2] for r in rows}:
        texts = [t for _, t, x in rows if x == lang and t]
        counts = Counter(w for t in texts for w in re.sub(r'[.,;:!?"()]', " ", t.lower()).split() if len(w) <= 8 and w.isalpha())
        common[lang] = {w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:50]}
        once = {tuple(re.sub(r'[.,;:!?"()]', " ", t.lower()).split()): t for t in sorted(texts, key=lambda t: -zlib.crc32(t.encode()))}
        words[lang], classes[lang] = Counter(), Counter()
        for key, t in once.items():
            n[lang] += bool(key)
            if key:
                for total, h in ((words[lang], plain_histogram(t, common[lang])), (classes[lang], Counter(map(plain_class, t)))):
                    total.update({k: v / sum(h.values()) for k, v in h.items()})
    every = sum(classes.values(), Counter())
    prior = {k: limits.prior_docs * v / sum(every.values()) for k, v in every.items()}
    main = [k for k in n if n[k] > 15 and n[k] >= 0.3 * sum(n.values())]
    assert 1 <= len(main) < len([k for k in n if n[k] > 15]) < len(n)

    def plain_distances(text, lang, leave_out):
        own_words, own_classes = plain_histogram(text, common[lang]), Counter(map(plain_class, text))
        by_words, by_classes = Counter(words[lang]), Counter(classes[lang])
        if words[lang]:
            by_classes.update(prior)
        if leave_out and own_words:
            for total, own in ((by_words, own_words), (by_classes, own_classes)):
                total.subtract({k: v / sum(own.values()) for k, v in own.items()})
        return plain_distance(own_words, {k: max(v, 0) for k, v in by_words.items()}), plain_distance(own_classes, {k: max(v, 0) for k, v in by_classes.items()})

    for doc, text, lang in rows:
        r, text = found[doc], text or ""
        by_word, by_class = plain_distances(text, lang, True) if n[lang] > 15 else min(plain_distances(text, k, False) for k in main)
        assert abs(r.class_distance - by_class) < 1e-4 and abs(r.word_distance - by_word) < 1e-4, (doc, r, by_class, by_word)
        bad = (len(text) >= limits.min_chars and by_class > limits.class_distance) or (r.n_words >= limits.min_words and by_word > limits.word_distance)
        assert r.kept == (not r.base_failed and not bad)
    assert {r.kept for r in found.values() if not r.base_failed} == {True, False}


@pytest.mark.parametrize("n_copies", [1, 40])
def test_junk_goes_whatever_its_language(spark, n_copies):
    rng = random.Random(8)
    junk = " ".join("".join(rng.choice("bcdfgjkqvwxz") for _ in range(rng.randint(3, 9))) for _ in range(150))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    good = docs.where("lang = 'en'").orderBy("doc_id").first().text
    rows = [(-1 - k, junk, lang) for k, lang in enumerate([None, "xx", "yy", "en"] + ["xx"] * n_copies)]
    found = quality_rules.apply_rules(docs.union(spark.createDataFrame(rows, docs.schema)))
    assert [r.kept for r in found.where("doc_id < 0").collect()] == [False] * len(rows)
    alone = docs.union(spark.createDataFrame([(-1, good + " indeed", "zz")], docs.schema))
    assert quality_rules.apply_rules(alone).where("doc_id = -1").first().kept == quality_rules.apply_rules(docs).where(F.col("text") == good).first().kept


def test_quality_rules_follow_the_labels(spark):
    found = QUERIES["op2_quality_rules"](spark, "/root/testdata/sf0.01").where("NOT base_failed")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = found.join(labels, "doc_id").select("kept", "quality").collect()
    assert np.mean([r.kept == bool(r.quality) for r in rows]) > 0.95


def test_main_text():
    page = (
        "<html><head><title>T one two</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><a href='/'>home page</a></nav>"
        "<div class='cookie-notice'>we use cookies</div><div class='ad'>buy this now please</div><article><h1>Head &amp; title</h1><p>First  para\n graph"
        "<br>here</p><aside>see also</aside><p>Second <b>bold</b> one.</p><form>name <input></form></article><div id='comments'>nice text</div>"
        "<footer>&copy; site</footer></body></html>"
    )
    weights = html_text.Weights({"article": 5.0, "/article": 5.0, "p": 0.001, "/p": 0.001, "h1": 0.001, "/h1": 0.001, "br": 0.001, "b": 0.001, "/b": 0.001, "aside": 0.001, "form": 0.001}, 2.0, 1.0)
    assert html_text.main_text(page, weights) == "Head & title\n\nFirst para graph here\n\nSecond bold one."
    assert html_text.main_text(None, weights) == html_text.main_text("", weights) == html_text.main_text("<p></p>", weights) == ""


LEARNED = html_text.Weights(
    {"p": 0.001, "/p": 0.001, "h1": 0.001, "/h1": 0.001, "article": 5.0, "/article": 5.0, "nav": 5.0, "footer": 5.0, "div.ad": 5.0}, 2.0, 1.0,
    {"ad": math.log(400), "<nav": math.log(400), "<footer": math.log(400)})
STORY = " ".join(f"word{k}" for k in range(60))


@pytest.mark.parametrize(("page", "want"), [
    # end tags that HTML implies end what is apart, too
    (f"<article><h1>Head</h1><p class=notice>Hear this<p>{STORY}<p>{STORY}</p></article>", ["Head", STORY, STORY]),
    (f"<article><ul><li class=share>Share me<li>{STORY}</ul><p>{STORY}</article>", [STORY, STORY]),
    # a part of a name is a weak hint
    (f"<article><h1>Head</h1><section id='related-work'><p>{STORY}</section><p>{STORY}</article>", ["Head", STORY, STORY]),
    (f"<body><div class='content has-sidebar'><h1>Head</h1><p>{STORY}</div><div class=sidebar>x y</div></body>", ["Head", STORY]),
    # no article element; an element apart without its end tag; one that wraps the page
    (f"<body><div class=ad>Buy now<h1>Head</h1><p>{STORY}<p>{STORY}</body>", ["Buy now", "Head", STORY, STORY]),
    (f"<body><nav>a b c</nav><div><div class=ad>Buy now</div><h1>Head</h1><p>{STORY}</div><div class='comments'>{STORY}</div><footer>x</footer>", ["Head", STORY]),
    (f"<form id=page><nav>a b</nav><h1>Head</h1><p>{STORY}</form>", ["Head", STORY]),
    (f"<nav>a</nav><table><tr><td>{STORY}<td>{STORY}<tr><td class=ad>buy</table>", [STORY, STORY]),
    ("</p></b></div>" + "<b>" * 50 + STORY, [STORY]),
])
def test_main_text_of_careless_pages(page, want):
    assert html_text.main_text(page, LEARNED) == "\n\n".join(want)


#: As the pages teach them: tags that were never met weigh nothing.
UNMET = html_text.Weights(LEARNED.tags, scale=8.0, marks=LEARNED.marks)


@pytest.mark.parametrize(("page", "want"), [
    # quotation marks where they do not belong
    (f"<article><p title=it's>{STORY}</p><p>it's {STORY}</p></article>", [STORY, f"it's {STORY}"]),
    (f"<article><p class=x\">{STORY}</p><p title=\"a\"b\">{STORY}</p><p title=\"never closed>{STORY}</article>", [STORY, STORY, STORY]),
    (f"<article><p title='a > b' data-x = y/z hidden>{STORY}</p><br/><img src=a.png / ><p = >{STORY}</p></article>", [STORY, STORY]),
    # tags that no page taught
    ("<article>" + "".join(f"<ul><li>w{k} x{k}</ul>" for k in range(30)) + "</article>", [f"w{k} x{k}" for k in range(30)]),
    ("<article><table>" + "".join(f"<tr><td>a{k}</td><td>b{k}</td></tr>" for k in range(40)) + "</table></article>", [f"{c}{k}" for k in range(40) for c in "ab"]),
    # comments of any length, in the article and outside, and nothing else
    (f"<article><p>{STORY}</p><section class=comments>" + f"<p>{STORY}" * 9 + "</section></article>", [STORY]),
    (f"<body><article><p>{STORY}</p></article><section class='reader comments'>" + f"<p>{STORY}" * 9 + "</section></body>", [STORY]),
    (f"<body><div class=sidebar>{STORY}</div><div class=ad>{STORY}</div></body>", []),
])
def test_no_text_is_lost_and_no_markup_or_comment_kept(page, want):
    assert html_text.main_text(page, UNMET) == "\n\n".join(want)


def test_what_is_apart_is_learned(spark):
    page = "<body><div class='teaser'>see {0} too</div><article><h1>T</h1><p>{1}</p><div class='promo'>{1}</div></article><div class='x-rail'>other {0}</div></body>"
    pages = spark.createDataFrame([(i, "u", page.format(i, STORY)) for i in range(200)], "page_id long, url string, html string")
    weights = html_text.learn_weights(pages)
    assert weights.apart("div", ("teaser",)) >= html_text.APART_FROM and weights.apart("div", ("x-rail",)) >= html_text.APART_FROM
    # a fixed name that the pages use inside their articles loses its weight
    assert weights.apart("div", ("promo",)) < html_text.APART_FROM
    plain = f"<body><div class='teaser'>see this</div><div><h1>T</h1><p>{STORY}</p><div class='promo'>{STORY}</div></div><div class='x-rail'>b</div></body>"
    assert html_text.main_text(plain, weights) == f"T\n\n{STORY}\n\n{STORY}"


def test_best_run_against_all_runs():
    rng = np.random.default_rng(0)
    for _ in range(200):
        scores = rng.integers(-4, 4, 12).astype(float).tolist()
        first, last = html_text.best_run(scores)
        assert sum(scores[first:last]) == max(0.0, *(sum(scores[i:j]) for i in range(12) for j in range(i + 1, 13)))


def test_equal_scores_go_to_smaller_ids_wherever_all_are_searched(spark):
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, (600, 4)).astype(float)
    data[:, 0] += 1
    data[300:] = [1.0, 1.0, 1.0, 1.0]
    order = rng.permutation(600).tolist()
    rows = [(i, data[i].tolist(), 1, "x") for i in order]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score string").repartition(3)
    found = {}
    for r in neighbours.nearest(frame, frame.where("vec_id % 20 = 0"), k=20, settings=neighbours.Settings(chance=1 - 1e-12)).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, 600, 20):
        score = data @ data[q]
        want = sorted((-score[i], i) for i in range(600) if i != q)[:20]
        assert sorted(found[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_a_tag_without_an_end_is_given_up_quickly():
    assert html_text.main_text("<p " + "a" * 200_000, LEARNED) == "<p " + "a" * 200_000
    assert html_text.main_text("<p a=\"" * 20_000, LEARNED)


def test_extraction_of_a_table(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    more = pages.union(spark.createDataFrame([(None, None, None), (1, "u", "")], pages.schema))
    found = {(r.page_id, r.url): r for r in html_text.extract(more.selectExpr("*", "1 AS n_chars", "'x' AS text")).collect()}
    assert found[None, None].text == "" and found[1, "u"].n_chars == 0
    for r in pages.collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        words = re.sub("<[^>]*>", " ", inner).replace("&amp;", "&").split()
        assert found[r.page_id, r.url].text.split() == words
    assert html_text.extract(pages.limit(0)).count() == 0


def test_lookup_table():
    names = [f"n{i}" for i in range(7)]
    table = sharding.lookup_table(names, 1009)
    assert set(Counter(table).values()) <= {1009 // 7, 1009 // 7 + 1}
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.25 * 1009
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1008)


def test_slots_and_table_against_plain_versions(docs):
    # each shard's whole order of slots is written out, and the shards take turns at the first that is free
    names = [f"shard-{i:05d}" for i in range(6)]
    size = 257
    orders = []
    for name in names:
        digest = hashlib.md5(name.encode()).hexdigest()
        offset, skip = int(digest[:16], 16) % size, int(digest[16:], 16) % (size - 1) + 1
        orders.append([(offset + j * skip) % size for j in range(size)])
    owner = {}
    while len(owner) < size:
        for shard, order in enumerate(orders):
            if len(owner) < size:
                owner[next(slot for slot in order if slot not in owner)] = shard
    assert sharding.lookup_table(names, size) == [owner[k] for k in range(size)]
    for r in sharding.assign_shards(docs, 6, table_size=size).collect():
        key = "null" if r.doc_id is None else str(r.doc_id)
        signed = (xxhash.xxh64_intdigest(key.encode(), 42) + 2**63) % 2**64 - 2**63
        assert r.slot == signed % size and r.shard == owner[r.slot]


def test_sharding(docs, empty, spark, tmp_path):
    found = sharding.assign_shards(docs, 5)
    assert found.count() == docs.count() and found.columns.count("shard") == 1
    table = sharding.lookup_table([f"shard-{i:05d}" for i in range(5)])
    assert all(r.shard == table[r.slot] for r in found.collect())
    assert sharding.assign_shards(empty, 5).count() == 0
    sharding.write_shards(docs.select("doc_id", "text"), str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_mixing_edge_cases(docs, empty):
    found = mixing.allocate(docs, keep=False)
    assert found.count() == docs.count()
    assert all(0 <= r.copies <= 2 for r in found.collect())
    again = mixing.allocate(docs.repartition(7), keep=False)
    assert sorted(map(str, found.collect())) == sorted(map(str, again.collect()))
    whole = mixing.allocate(docs)
    assert whole.columns.count("size") == 1 and whole.count() == docs.count()
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.allocate(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixing_against_sql_and_targets(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{FOLDER}/documents.parquet')")
    con.execute(ORACLE_SQL["op7_mixing"])
    want = sorted((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in con.fetchall())
    got = QUERIES["op7_mixing"](spark, FOLDER).collect()
    assert sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == want


def test_inclusion_follows_the_odds(spark):
    # one source of many documents beside a small one, so that the first is taken in part and the second as a whole
    rng = random.Random(1)
    sizes = [rng.choice([1, 3, 12, 50, 200]) for _ in range(40_000)]
    rows = [(i, "w " * n, "a") for i, n in enumerate(sizes)] + [(-1, "w " * 900_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.allocate(docs, (1.0, 3.0), 0.5, keep=False).where("id >= 0").collect()
    target, words = found[0].target, sum(sizes)
    level = target / sum(n * n.bit_length() for n in sizes)
    assert abs(sum(r.copies * r.size for r in found) - target) <= 100 and target < 0.5 * words
    for n in sorted(set(sizes)):
        rate, want = np.mean([r.copies for r in found if r.size == n]), level * n.bit_length()
        assert 0 < want < 1 and abs(rate - want) < 5 * math.sqrt(want * (1 - want) / sizes.count(n)), (n, rate, want)


def test_encoder_with_a_small_memory_gives_the_tokenizers_ids(monkeypatch):
    monkeypatch.setattr(packing, "WORDS_KEPT", 40)
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghiklmnoprstuß日.,'|-<>3", k=rng.randint(1, 9))) for _ in range(400)] + ["<|endoftext|>", "don't", "a|b"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 300))) for _ in range(30)] + ["", " \n\t", "x" * 3000, " ".join(words * 40)]
    encoder, plain = packing._WordEncoder(TOKENS), Tokenizer.from_file(TOKENS)
    for at in range(0, len(texts), 3):
        for text, data in zip(texts[at:at + 3], encoder.ids(texts[at:at + 3])):
            assert np.frombuffer(data, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(encoder.known) <= 40 + len(words) + 1


def test_shortest_pack_first():
    rng = np.random.default_rng(2)
    counts = Counter(int(x) for x in rng.integers(1, 101, 3000))
    packs = packing.pack_histogram(counts, 100)
    placed = Counter()
    for n, lengths in packs:
        assert sum(lengths) <= 100
        for x in lengths:
            placed[x] += n
    assert placed == counts
    assert sum(n for n, _ in packs) * 100 < 1.03 * sum(k * v for k, v in counts.items()) + 100
    assert packing.pack_histogram({}, 100) == []


def test_packing_round_trip(docs, empty):
    pieces = packing.tokenize_pieces(docs, TOKENS, 64, with_ids=True)
    packed = packing.pack(pieces, 64)
    rows = packed.collect()
    tokenizer = Tokenizer.from_file(TOKENS)
    want = Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 64):
            part = np.array(ids[at:at + 64], "<u4").tobytes()
            want[r.doc_id, at, len(part) // 4, zlib.crc32(part), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    made = packing.sequences(packed, 64).collect()
    assert len(made) == len(by_sequence) and all(len(r.ids) == 64 or len(r.ids) & (len(r.ids) - 1) == 0 for r in made)
    assert packing.pack_documents(empty, TOKENS).count() == 0


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    vectors = [(i, (centres[i % 12] + 0.4 * rng.standard_normal(16)).tolist()) for i in range(1500)]
    vectors += [(2000 + i, vectors[20][1]) for i in range(60)]
    bad = [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [None] * 16), (None, [1.0] * 16), (3004, [1.0] * 3), (3005, [])]
    frame = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<float>")
    settings = neighbours.Settings(cell_rows=200, leaf=16, cell_queries=16)
    found = neighbours.nearest(frame, frame.where("vec_id % 20 = 0"), 10, settings).collect()
    ids, x = np.array([v[0] for v in vectors]), np.array([v[1] for v in vectors], np.float32).astype(float)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[q]
        order = [k for k in np.lexsort((ids, -scores)) if k != q][:10]
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == ids[q])
        assert [r[0] for r in own] == list(range(1, 11))
        hits += len({ids[k] for k in order} & {r[1] for r in own})
        total += 10
        assert all(abs(s - scores[list(ids).index(v)]) < 1e-9 for _, v, s in own)
    assert hits / total >= 0.9
    assert neighbours.nearest(frame.limit(0), frame.limit(0)).count() == 0
    few = neighbours.nearest(frame.where("vec_id < 5"), frame.where("vec_id = 0"), 10).collect()
    assert len(few) == 4


def test_neighbours_of_unclustered_vectors_in_bounded_groups(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1200, 24))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    held = neighbours.search_cell

    def bounded(vectors, least_ids, queries, *rest):
        assert len(vectors) <= 2 * 64 and len(queries) <= 3 * 8, (len(vectors), len(queries))
        return held(vectors, least_ids, queries, *rest)

    monkeypatch.setattr(neighbours, "search_cell", bounded)
    found = neighbours.nearest(frame, frame.where("vec_id % 20 = 0"), 10, neighbours.Settings(cell_rows=64, fit_rows=100, leaf=8, cell_queries=8)).collect()
    got = {q: {r.vec_id for r in found if r.query_id == q} for q in range(0, 1200, 20)}
    hits = sum(len(got[q] & set([k for k in np.argsort(-(x @ x[q])) if k != q][:10])) for q in got)
    assert hits / (10 * len(got)) >= 0.9


def test_neighbours_with_repeated_ids_and_lengths(spark):
    a, b, c = [1.0, 0.0, 2.0], [0.5, 0.5, 0.5], [3.0, 4.0]
    rows = [(20, a, 0), (20, a, 0), (20, b, 0), (3, a, 1), (4, b, 1), (40, c, 1), (5, [1.0, 1.0], 1), (6, [2.0], 1), (60, [5.0], 1), (80, [1.0] * 7, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    found = neighbours.nearest(frame, frame.where("vec_id % 20 = 0"), 10).collect()
    got = Counter((r.query_id, r.rank, r.vec_id, r.score) for r in found)
    # query 20 with vector a: its own row is left out, the repeated one and those of another vector are not
    want = [(20, 1, 3, 5.0), (20, 2, 20, 5.0), (20, 3, 4, 1.5), (20, 4, 20, 1.5)]
    want += [(20, 1, 3, 1.5), (20, 2, 20, 1.5), (20, 3, 20, 1.5), (20, 4, 4, 0.75)]
    assert got == Counter([*want, (40, 1, 5, 7.0), (60, 1, 6, 10.0)])


def test_classifier_accuracy_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op10_quality_classifier"](spark, folder)
    rows = found.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_updates_against_a_plain_loop():
    settings = classifier.Settings(bits=6, epochs=2)
    texts = [("good clean words here", 1), ("bad bad junk ### bad", 0), ("", 0), ("good words good words good words", 1), ("junk here", 0)]
    examples = [(classifier.features(t, 6), y) for t, y in texts]
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= settings.l1:
            return 0.0
        return -(z[i] - math.copysign(settings.l1, z[i])) / ((settings.beta + math.sqrt(n[i])) / settings.alpha + settings.l2)

    for _ in range(settings.epochs):
        for at, y in examples:
            x = {i: c / math.sqrt(max(1, len(at))) for i, c in Counter(at.tolist()).items()} | {"bias": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / settings.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    weights, bias = classifier.fit_shard([(classifier.example(t, 6), y) for t, y in texts], settings)
    assert abs(bias - weight("bias")) < 1e-6 and np.allclose(weights, [weight(i) for i in range(64)], atol=1e-6)
    long = classifier.example("many words of one text " * 100_000, 6)
    assert len(long) <= 64 and abs(float((long["value"] ** 1).sum()) - math.sqrt(len(classifier.features("many words of one text " * 100_000, 6)))) < 1
    for text, _ in texts:
        at = classifier.features(text, 6).tolist()
        plain = 1 / (1 + math.exp(-(bias + sum(weights[i] for i in at) / math.sqrt(max(1, len(at))))))
        assert abs(classifier.score_text(text, weights, bias, 6) - plain) < 1e-9


def test_classifier_edge_cases(docs, empty, spark):
    labels = spark.createDataFrame([(4, 1), (4, 1), (5, 0), (6, None), (None, 1), (99, 1)], "doc_id long, quality int")
    model = classifier.train(docs, labels, classifier.Settings(bits=10))
    found = classifier.score(docs, model, bits=10)
    assert found.columns.count("score") == 1 and all(0 <= r.score <= 1 for r in found.collect())
    assert classifier.score(empty, model, bits=10).count() == 0
    nothing = classifier.train(docs, labels.limit(0), classifier.Settings(bits=10))
    assert {r.score for r in classifier.score(docs, nothing, bits=10).collect()} == {0.5}


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    story = " ".join(f"word{k} and so" for k in range(200))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, story, "en", "a", 1), (3, story, "en", "a", 1), (None, story + " too", None, None, None),
            (4, story + "\n" + story, "en", "b", 1), (5, "x" * 60_000, "en", "b", 1), (6, " ".join(f"t{k}" for k in range(30_000)), "en", "b", 1)]
    odd, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        found, nothing = stage(spark, odd, FOLDER), stage(spark, none, FOLDER)
        assert nothing.count() == 0 and found.columns == (found.columns if name == "pack" else odd.columns), name
        kept = Counter(r.doc_id for r in found.collect())
        if name == "quality":
            assert 1 not in kept and 2 not in kept and kept[3] in (0, 2)
        if name == "lines":  # the nameless document comes first, so of the others only what it lacks is left
            assert kept[1] == kept[2] == 1 and kept[6] == 1 and kept[None] == 1
        if name == "near_dedup":  # texts that are null, empty or of one unknown kind are one group
            assert kept[3] + kept[None] + kept[4] >= 1 and kept[6] == 1 and max(kept.values()) == 1
        if name == "mix":
            assert max(kept.values()) <= 4 and set(kept) <= {r[0] for r in rows}
        if name == "pack":
            assert set(kept) == {r[0] for r in rows}


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    good = corpus_pipeline.quality(spark, docs, FOLDER)
    kept = {r.doc_id for r in QUERIES["op2_quality_rules"](spark, FOLDER).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept and good.columns == docs.columns
    found = corpus_pipeline.run(spark, FOLDER)
    ids = {r.doc_id for r in found.select("doc_id").distinct().collect()}
    assert ids and ids <= kept
