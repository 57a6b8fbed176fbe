"""Tokenizer alignment, token counts and conversation repair against plain versions, and their odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import product

import duckdb
import public_tokenizers
import pytest

from terrasift.llm import alignment, conversations, token_counts
from terrasift.llm.queries import QUERIES
from terrasift.llm.sql import ORACLE_SQL
from terrasift.llm.token_models import PieceModel, load

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row int, pairs string, part long, n_tokens string"
ODD = [
    None, "", " ", "\n\n", "a\r\nb;\r c", "x  y", "漢字 😀 a😀b", chr(0x2581) + "x", "<|endoftext|> <s> </s><unk>", "a\tb \t c\n\n d", "don't  stop   \n\n  it's",
    "é e" + chr(0x301) + " x", chr(0x3000) + " x  \ny" + chr(0x1C) + " z" + chr(0x85) + " w", "z" * 3000, "漢" * 900, "hello world " * 300, "\x00a\x00 b", "cat sat. " * 40]


def random_texts(n, alphabet, longest, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, longest))) for _ in range(n)]


ALPHABET = "abcdefgh    \n\r\té漢😀'" + chr(0x2581) + "<|>.,;" + chr(0x301) + chr(0xA0)


@pytest.fixture(scope="module")
def texts():
    return ODD + random_texts(200, ALPHABET, 60) + random_texts(60, "ab  c\n", 700) + ODD[:9]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(None if i == 5 else i, t, 1, "p", 2, "n") for i, t in enumerate(texts)], SCHEMA).repartition(3)


def plain_alignment(text):
    """Ids of both sides and the groups, from whole-text encodings and decoded bytes alone."""
    if not text:
        return [], [], []
    a_model, b_model = load(A), load(B)
    data = (" " + text).encode()
    a = a_model.tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = b_model.processor.encode(text, num_threads=1, return_type=int)
    sides = [[], []]
    for ids, side, model in ((a, sides[0], a_model), (b, sides[1], b_model)):
        at = 0
        for i in ids:
            side.append((i, at, at + len(model.token_bytes[i])))
            at = side[-1][2]
        if b"".join(model.token_bytes[i] for i in ids) != data:
            return [], [], []
    cuts = sorted({e for *_, e in sides[0]} & {e for *_, e in sides[1]})
    groups, low = [], 0
    for cut in cuts:
        groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= cut) for side in sides))
        low = cut
    links = [(i, j) for i, s, e in sides[0] for j, s2, e2 in sides[1] if s < e2 and s2 < e]
    return sides, groups, links


def test_alignment_equals_whole_text_encodings(docs, texts):
    texts = [t if t is None or len(t) < 1500 else t[:1500] for t in texts]
    short = docs.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: plain_alignment(t) for i, t in enumerate(texts)}
    counts = Counter(p for _, _, links in want.values() for p in links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    found = alignment.align_and_score(short, A, B, with_groups=True).collect()
    assert len(found) == len(texts)
    for r in found:
        sides, groups, links = want[r.doc_id]
        assert (r.n_a, r.n_b) == (len(sides[0]), len(sides[1])) if sides else (r.n_a, r.n_b) == (0, 0)
        assert r.groups == ";".join(groups) and r.n_groups == len(groups) and r.n_links == len(links)
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if groups else "")
        assert r.n_best == sum(counts[p] == best[p[1]] for p in links) and r.count_sum == sum(counts[p] for p in links)


def test_alignment_joins_through_a_shuffle_when_pairs_are_many(docs, monkeypatch):
    few = alignment.align_and_score(docs, A, B)
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)
    many = alignment.align_and_score(docs, A, B)
    assert "doc_id" in many.columns and "row" not in many.columns
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and few.count() == docs.count()


def test_alignment_of_no_rows(spark):
    assert alignment.align_and_score(spark.createDataFrame([], SCHEMA), A, B).count() == 0


def test_spans_are_refined_where_tokens_share_a_character():
    a, b = load(A), load(B, prefix=False)
    for text in (" 漢字 😀x", " é漢", " plain words"):
        for model in (a, b):
            ids, spans = model.encode([text])[0]
            ends = alignment.byte_ends(ids, spans, model.token_bytes)
            at, want = 0, []
            for i in ids:
                at += len(model.token_bytes[i])
                want.append(at)
            assert ends == want


def test_parts_without_the_added_space_encode_as_the_whole(texts):
    whole, parts = load(B), load(B, prefix=False)
    for text in filter(None, texts):
        assert parts.processor.encode(" " + text, return_type=int) == whole.processor.encode(text, return_type=int)


@pytest.mark.parametrize("chunk, overlap", [(64, 64), (100, 1000), (300, 20), (65536, 16384)])
def test_counts_equal_the_library_on_whole_texts(docs, texts, chunk, overlap):
    library = load(B).processor
    found = token_counts.count_tokens(docs, B, 50, chunk=chunk, overlap=overlap).collect()
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in found)
    want = sorted(((-1 if i == 5 else i), len((t or "").encode()), n := len(library.encode(t or "")), n > 50) for i, t in enumerate(texts))
    assert got == want


def test_no_encoding_has_a_token_across_a_stable_place(texts):
    model = load(B)
    for text in random_texts(50, ALPHABET, 200, seed=8):
        begins = set(model.begins(text).tolist())
        assert all(p in begins for p in range(1, len(text)) if model.stable(text[p - 1], text[p]))
    assert not model.stable("t", "h") and model.stable("t", " ")


def test_a_vocabulary_that_proves_nothing_is_used_on_whole_texts(docs, texts, monkeypatch):
    assert isinstance(load(B), PieceModel)
    assert token_counts.seam(load(B), "z" * 500, 400) == []
    assert token_counts.count_tokens(docs.limit(0), B).count() == 0


ROLES, TEXTS = ["user", "assistant", "system", "tool", "", None], ["Hi.", "b!", "c", "", "  ", "x. \n", "no\nend", None, "é?"]


@pytest.fixture(scope="module")
def talks(spark, tmp_path_factory):
    rnd = random.Random(5)
    rows = [(c, rnd.choice([None, *range(6)]) if rnd.random() < 0.4 else k, rnd.choice(ROLES[:3] * 2 + ROLES), rnd.choice(TEXTS), "x")
            for c in [*range(600), None] for k in range(rnd.randint(0, 9))]
    rows += [(700, k, ROLES[k % 2 if k < 500 else 0], f"t{k}.", "x") for k in range(700)]
    folder = str(tmp_path_factory.mktemp("talks"))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string").repartition(3).write.parquet(f"{folder}/conversations.parquet")
    return folder


def plain_repair(rows):
    """The least (cost, audit) over all edits of at most three rows, each with up to two rows inserted before and after."""
    best = None
    for inserted in product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
        for edits in product("DKua", repeat=len(rows)):
            cost, audit, roles = 3 * len(inserted[0]), "I" * len(inserted[0]), inserted[0]
            for (initial, gone, truncated), edit, more in zip(rows, edits, inserted[1:]):
                if edit != "D" and gone:
                    break
                cost += {"D": 4, "K": 0}.get(edit, 3) + (3 if edit != "D" and truncated else 0) + 3 * len(more)
                audit += (edit if edit in "DK" else "R") + "I" * len(more)
                roles += {"D": "", "K": initial or "?"}.get(edit, edit) + more
            else:
                if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def test_parse_against_all_edits():
    rnd = random.Random(2)
    for _ in range(60):
        rows = [(rnd.choice("suat"), rnd.random() < 0.2, rnd.random() < 0.3) for _ in range(rnd.randint(0, 3))]
        parse = conversations.Parse()
        for initial, gone, truncated in rows:
            parse.read({"s": "system", "t": "tool"}.get(initial, conversations.ROLES.get(initial)), "x", gone, truncated and not gone)
        assert parse.result()[:2] == plain_repair([(i, g, t and not g) for i, g, t in rows])


def test_repair_against_sql_and_its_rows(spark, talks):
    found = QUERIES["op13_conversation_repair"](spark, talks)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{talks}/conversations.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["op13_conversation_repair"])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(found.columns)
    rows = found.select(columns).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want.fetchall()))
    hurt = conversations.damage(spark.read.parquet(f"{talks}/conversations.parquet"))
    kept = defaultdict(list)
    for r in conversations.repaired_rows(hurt, found).orderBy("conv_id", "place").collect():
        kept[r.conv_id].append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(kept[r.conv_id]).encode()).hexdigest() == r.repaired_sha256 for r in rows)


def test_repair_of_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(conversations.damage(none), conversations.all_ids(none)).count() == 0
    r = conversations.repair(none, spark.createDataFrame([(7,)], "conv_id long")).collect()[0]
    assert (r.conv_id, r.gaps, r.cost, r.audit, r.repaired_sha256) == (7, 0, 0, "", hashlib.sha256(b"").hexdigest())
