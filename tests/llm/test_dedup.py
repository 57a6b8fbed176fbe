"""Near-dedup, line dedup and substring removal against brute force."""

import collections
import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from terrasift.llm import components, line_dedup, simhash, substring_dedup

SCHEMA = "doc_id long, text string, n long, component_id string"


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutate(rng, text, k):
    out = list(text)
    for _ in range(k):
        i, kind = rng.randrange(len(out)), rng.randrange(3)
        out[i:i + (kind != 1)] = [] if kind == 0 else [rng.choice("abcé ")]
    return "".join(out)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(300)]
    texts = [None, "", "   ", "One", "one", "a b", "A b"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(60, 250))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts.append(" ".join(rng.choice(words) for _ in range(30_000)))
    rows = [(i, t, 0, "clash") for i, t in enumerate(texts)] + [(None, "one", 0, None), (3, "One", 0, None)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    prints = [plain_fingerprint(t) for _, t, _, _ in rows]
    reach = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = reach[i], reach[j]
                reach = [min(a, b) if x in (a, b) else x for x in reach]
    least = {}
    for (doc, *_), c in zip(rows, reach):
        least[c] = min(x for x in (doc, least.get(c)) if x is not None) if doc is not None or least.get(c) is not None else None
    want = collections.Counter((rows[i][0], prints[i], least[reach[i]]) for i in range(len(rows)))
    got = collections.Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in found)
    assert got == want
    kept = simhash.deduplicate(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "n", "component_id"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_simhash_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


def test_dense_cells_are_compared_whole(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63)
    prints = np.unique(np.array([base ^ (1 << int(b)) ^ (1 << int(c)) for b, c in rng.integers(0, 62, (200, 2))], np.int64))
    u, v = simhash._cell_edges(prints, 3)
    node, root = components.spanning_stars(u, v)
    assert len(set(root)) == 1 and len(node) == len(prints) - 1


def test_connected_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    found = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_edit_distance_and_join(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(25):
        base = "".join(rng.choice("abcde é") for _ in range(rng.randint(24, 45)))
        pairs += [(base, mutate(rng, base, k)) for k in range(6)]
    lines = sorted({x.strip() for p in pairs for x in p if len(x.strip()) >= 24})
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    frame = frame.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(3), "line").alias("h2"), "line", F.length("line").alias("n"))
    text = {r.h1: r.line for r in frame.collect()}
    for most in (1, 2):
        df = spark.createDataFrame(pairs, "a string, b string")
        t = line_dedup.trimmed(F.col("a"), F.col("b"), most)
        df = df.select("a", "b", line_dedup.within_edits(F.col("a"), F.col("b"), most).alias("w"), line_dedup.within_edits(t["a"], t["b"], most).alias("t"))
        assert all(r.w == r.t == (edit(r.a, r.b) <= most) for r in df.collect())
        got = {tuple(sorted((text[r.a1], text[r.b1]))) for r in line_dedup.near_links(frame, most).collect()}
        assert got == {(a, b) for i, a in enumerate(lines) for b in lines[i + 1:] if abs(len(a) - len(b)) <= most and edit(a, b) <= most}


def test_line_dedup_edge_cases(spark):
    long = "this line is long enough to have near copies"
    rows = [
        (1, f"{long}\n\nshort\n{long}", 0, "x"), (2, f"{long.upper()}s\nown words of the second", 0, "x"), (3, None, 0, "x"), (4, "", 0, "x"),
        (5, long, 0, "x"), (None, "short\nonly the nameless one has this", 0, "x"), (6, "alone", 0, "x"), (6, "alone", 0, "x"), (7, "z" * 60_000, 0, "x"),
    ]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "n", "component_id"]
    got = {(r.doc_id, r.text) for r in out.collect()}
    # the nameless document comes first, so the repeat of its line goes from document 1
    assert got == {(1, f"{long}\n"), (2, "own words of the second"), (3, None), (4, ""), (None, rows[5][1]), (6, "alone"), (7, "z" * 60_000)}
    assert out.where("doc_id = 6").count() == 2
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_line_decisions_against_brute_force(spark):
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefg é") for _ in range(rng.randint(9, 40))).strip() for _ in range(25)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 7)):
            line = rng.choice(base)
            lines.append(rng.choice([line, line.upper(), "  " + line.replace(" ", " \t"), mutate(rng, line, rng.randint(1, 3)), "", "tiny"]))
        rows.append((i if i % 9 else None, "\n".join(lines) if i % 11 else None))
    rows += [rows[5], (500, ""), (501, " \n \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    found = line_dedup.line_decisions(docs)
    known = {(r.doc_id, r.text or ""): r.h for r in docs.select("doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h")).collect()}
    places = []
    for doc, text in sorted({(d, t or "") if t is not None else (d, None) for d, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0, known[x[0], x[1] or ""])):
        for pos, line in enumerate((text or "").split("\n")):
            line = " ".join(line.lower().split())
            if line:
                places.append((doc, known[doc, text or ""], pos, line))
    first = {}
    for at, (*_, line) in enumerate(places):
        first.setdefault(line, at)
    near = {a: {b for b in first if b != a and len(a) >= 10 and len(b) >= 10 and abs(len(a) - len(b)) <= 2 and edit(a, b) <= 2} for a in first}
    want = {(d, known[d, t or ""]): [0, set(), set(), 0] for d, t in rows}
    kept = []
    for at, (doc, h, pos, line) in enumerate(places):
        out = want[doc, h]
        out[0] += 1
        if first[line] != at:
            out[1].add(pos)
        else:
            out[3] += len(near[line])
            if any(first[b] < at for b in near[line]):
                out[2].add(pos)
        if pos not in out[1] | out[2]:
            kept.append((doc, h, pos, line))
    hashed = spark.createDataFrame(kept, "doc long, h long, pos int, line string")
    hashed = hashed.groupBy("doc", "h").agg(F.bit_xor(F.xxhash64("pos", F.xxhash64("line"), F.xxhash64(F.lit(3), "line"))).alias("x"))
    hashes = {(r.doc, r.h): r.x for r in hashed.collect()}
    got = {(r.id, r.hash): ([r.n_lines, set(r.repeats), set(r.nears), r.n_links], r.kept_hash) for r in found.collect()}
    assert got == {k: (v, hashes.get(k, 0)) for k, v in want.items()}
    assert sum(len(v[2]) for v in want.values()) > 5 and sum(len(v[1]) for v in want.values()) > 20


def test_substring_removal(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh é\n") for _ in range(rng.randint(300, 1200))) for _ in range(10)]
    rows = []
    for i in range(30):
        b, c, a = rng.choice(base), rng.choice(base), rng.randint(0, 150)
        rows.append((i, rng.choice([b, b[a:] + c[:500], b[:a] + "X" + b[a + 1:], "ab" * rng.randint(100, 500), "q" * rng.randint(300, 700), ""])))
    rows += [(90, None), (None, base[0]), (91, "same " * 5), (91, "same " * 5)]
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 400, digest=True).collect()
    docs = [(d, (t or "").encode()) for d, t in rows]
    times = collections.Counter(x[p:p + 400] for _, x in docs for p in range(len(x) - 399))
    want = collections.Counter()
    for d, x in docs:
        gone = [False] * len(x)
        for p in range(len(x) - 399):
            if times[x[p:p + 400]] > 1:
                gone[p:p + 400] = [True] * 400
        left = bytes(v for v, g in zip(x, gone) if not g)
        want[d, len(x), sum(gone), sum(g and (q == 0 or not gone[q - 1]) for q, g in enumerate(gone)), hashlib.sha256(left).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == want
    texts = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 400)
    assert texts.columns == ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "n_passage"] and texts.count() == len(rows)
    passages_are_between(rows, found)


def passages_are_between(rows, found):
    """n_passage covers 237 bytes of every repeated string of 300 and nothing that is not in a repeated string of 237."""
    def covered(width):
        times = collections.Counter(x[p:p + width] for x in texts for p in range(len(x) - width + 1))
        out = []
        for x in texts:
            gone = {q for p in range(len(x) - width + 1) if times[x[p:p + width]] > 1 for q in range(p, p + width)}
            out.append(len(gone))
        return out

    texts = [(t or "").encode() for _, t in rows]
    got = collections.defaultdict(set)
    for r in found:
        got[r.doc_id, r.n_bytes].add(r.n_passage)
    for (doc, _), x, least, most in zip(rows, texts, covered(300), covered(237)):
        assert any(min(least, 237) <= n <= most for n in got[doc, len(x)]), (doc, least, most, got[doc, len(x)])


def test_windows_are_compared_by_all_bits_of_their_hash(spark):
    values = [b"abcdef\x01\x00", b"abcdef\x02\x00", b"abcdef\x00\x01", b"abcdef\x00\x01"]
    rows = [(7, i, 0, 100 * i, 50, False, bytearray(substring_dedup.MARK + v)) for i, v in enumerate(values)]
    rows.append((8, 9, 0, 0, 50, False, bytearray(substring_dedup.MARK + values[0])))
    units = spark.createDataFrame(rows, "unit long, id long, hash long, start long, core long, settled boolean, windows binary").coalesce(1)
    found = {tuple(r) for r in substring_dedup._repeated_windows(units, 10).collect()}
    assert found == {(2, 0, 0, 200, 200), (3, 0, 0, 300, 300), *((i, 0, 1, 50, 59) for i in range(4))}


def test_large_units_are_compared_in_blocks(spark, monkeypatch):
    # one passage in differing surroundings, some runs of which are equal as a whole
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    other = ["".join(rng.choice("ijklmnop ") for _ in range(300)) for _ in range(40)]
    rows = [(i, other[i % 30] + passage[i % 7:850 + i % 11] + other[39 - i % 37]) for i in range(40)] + [(50, None), (51, other[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(substring_dedup, "UNIT_ROWS", 5)
    blocks, held = [], substring_dedup._repeated_in_blocks
    monkeypatch.setattr(substring_dedup, "_repeated_in_blocks", lambda units, core: blocks.append(units) or held(units, core))
    found = {r.doc_id: r.kept_sha256 for r in substring_dedup.remove_repeats(docs, 400, digest=True).collect()}
    times = collections.Counter((t or "")[p:p + 400] for _, t in rows for p in range(len(t or "") - 399))
    for d, t in rows:
        gone = {q for p in range(len(t or "") - 399) if times[t[p:p + 400]] > 1 for q in range(p, p + 400)}
        assert found[d] == hashlib.sha256("".join(c for q, c in enumerate(t or "") if q not in gone).encode()).hexdigest()
    sizes = [r["n"] for r in blocks[0].groupBy("unit", F.pmod(F.xxhash64("id", "hash", "start"), F.col("blocks"))).agg(F.count("*").alias("n")).collect()]
    whole = [r["n"] for r in blocks[0].groupBy("unit").agg(F.count("*").alias("n")).collect()]
    assert max(whole) > 20 and max(sizes) <= 15


def test_substring_removal_of_a_very_long_text_and_clashing_columns(spark):
    rng = random.Random(9)
    long = "".join(rng.choices("abcdefghijkl mnop", k=substring_dedup.CHUNK + 60_000))
    low = substring_dedup.CHUNK - 700  # the repeat lies on both sides of the place where the text is cut
    rows = [(1, long, 7, "a", 1), (2, "x" + long[low:low + 1300] + "yz", 7, "b", 2), (3, long[:390], 7, "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes long, n_spans string, n_passage int")
    found = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert found[1].text == long[:low] + long[low + 1300:] and found[2].text == "xyz" and found[3].text == long[:390]
    assert [(found[d].n_bytes, found[d].n_removed, found[d].n_spans) for d in (1, 2, 3)] == [(len(long), 1300, 1), (1303, 1300, 1), (390, 0, 0)]
    assert found[3].n_passage > 0 and found[1].n_passage >= 1000


def test_substring_removal_of_an_empty_table(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), 400, digest=True).count() == 0
