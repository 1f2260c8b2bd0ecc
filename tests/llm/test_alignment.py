"""Alignment of two tokenizers against a plain statement of the result."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from public_tokenizers import path
from scholarlens.llm import alignment
from scholarlens.llm.queries import LEFT_TOKENIZER, RIGHT_TOKENIZER, op12_tokenizer_alignment

HARD = ["", None, "<|endoftext|> <s> </s>", "x▁y", "aé", "日本語 text 😀", "a" * 30_000, " ", "  ",
        "a   b\n  c \n\n d  ", "x\x1c y", "\n a   b  c", "tab\tbed 's don't 12 345", "​", "<0x41>",
        "same words", "same words", "ﬁ ﬀ é"]


def byte_chars():
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer
    left = Tokenizer.from_file(path(LEFT_TOKENIZER))
    left.encode_special_tokens = True
    return left, sentencepiece.SentencePieceProcessor(model_file=path(RIGHT_TOKENIZER))


def plain(texts, coders):
    """Groups, links and counts by lists and dictionaries."""
    left, right = coders
    chars, rows = byte_chars(), []
    for text in texts:
        a, b = [], []
        if text:
            ids = left.encode(" " + text, add_special_tokens=False).ids
            a = [(i, bytes(chars[c] for c in left.id_to_token(i))) for i in ids]
            for i in right.encode(text):
                piece = right.id_to_piece(i)
                byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
                b.append((i, bytes([int(byte[1], 16)]) if byte
                          else piece.replace("▁", " ").encode()))
            whole = (" " + text).encode()
            if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
                a, b = [], []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, raw in side:
                out.append((at, at + len(raw), i))
                at += len(raw)
            spans.append(out)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        walks, parts = [iter(side) for side in spans], []
        for hi in cuts:
            sides = []
            for walk in walks:
                ids = []
                for _, e, i in walk:
                    ids.append(str(i))
                    if e == hi:
                        break
                sides.append(",".join(ids))
            parts.append("|".join(sides))
        said = ";".join(parts)
        links, j = [], 0
        for s, e, i in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        rows.append((len(a), len(b), len(cuts), links, said))
    held = Counter(p for *_, links, _ in rows for p in set(links))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return [(n_a, n_b, n, len(links), sum(held[p] == most[p[0]] for p in links),
             sum(held[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if said else "")
            for n_a, n_b, n, links, said in rows]


def test_query_equals_plain_statement(spark, coders):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in docs], plain([r.text for r in docs], coders)))
    got = {r[0]: tuple(r[1:]) for r in op12_tokenizer_alignment(spark, sf).collect()}
    assert got == want


def test_hard_texts_repeats_and_clashing_names(spark, coders):
    names = "row long, text string, block long, doc string, held int, a int"
    docs = spark.createDataFrame([(i, t, 1, "d", 2, 3) for i, t in enumerate(HARD)], names)
    found = alignment.measured(docs.union(docs), path(LEFT_TOKENIZER), path(RIGHT_TOKENIZER))
    want = plain(HARD * 2, coders)
    rows = sorted(found.collect(), key=lambda r: r.row.row)
    assert len(rows) == 2 * len(HARD)
    for k, r in enumerate(rows):
        assert tuple(r[1:]) == want[k // 2], HARD[k // 2]
        assert (r.row.block, r.row.held) == (1, 2)


def test_groups_spell_the_text(spark, coders):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    want = plain(HARD, coders)
    for r in alignment.groups(docs, path(LEFT_TOKENIZER), path(RIGHT_TOKENIZER)).collect():
        a, b = iter(r.a_ids), iter(r.b_ids)
        said = ";".join(",".join(str(next(a)) for _ in range(n)) + "|" + ",".join(
            str(next(b)) for _ in range(m)) for n, m in zip(r.a_sizes, r.b_sizes))
        assert (hashlib.sha256(said.encode()).hexdigest() if said else "") == want[r.row.doc_id][-1]


def test_a_single_space_at_the_end_has_its_tokens(spark, coders):
    texts = ["a ", "... ", "a  ", "a\n ", "a \n", "日本 ", "x▁ ", "one two  three "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = alignment.measured(docs, path(LEFT_TOKENIZER), path(RIGHT_TOKENIZER))
    got = {r.row.doc_id: tuple(r[1:]) for r in found.collect()}
    assert got == dict(enumerate(plain(texts, coders)))
    assert [got[i][0] > 0 for i in range(len(texts))] == [t != "x▁ " for t in texts]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.measured(docs, path(LEFT_TOKENIZER), path(RIGHT_TOKENIZER)).count() == 0


@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=40),
                          st.lists(st.integers(1, 4), min_size=1, max_size=40)), max_size=6))
def test_cuts_are_all_common_ends(pairs):
    a_ends, b_ends, at, base = [], [], [0], 0
    for a, b in pairs:
        short = sum(a) - sum(b)
        (b if short > 0 else a).extend([1] * abs(short))
        a_ends += list(base + np.cumsum(a))
        b_ends += list(base + np.cumsum(b))
        base += sum(a)
        at.append(len(a_ends))
    a, b, at = np.array(a_ends, int), np.array(b_ends, int), np.array(at)
    cut = alignment.shared_cuts(a, b, at[:-1], at[1:])
    assert cut.tolist() == np.isin(a, b).tolist()


def test_long_stretches_without_a_cut():
    a, b = np.arange(2, 40_002, 2), np.append(np.arange(1, 39_999, 2), 40_000)
    cut = alignment.shared_cuts(a, b, np.array([0]), np.array([len(a)]))
    assert np.flatnonzero(cut).tolist() == [len(a) - 1]


def test_memory_begun_anew_changes_nothing(monkeypatch):
    left = alignment.byte_level(path(LEFT_TOKENIZER))
    right = alignment.sentence_pieces(path(RIGHT_TOKENIZER))
    texts = [f"word{i} and another{i % 7} one" for i in range(50)]
    whole = alignment.Words(left, right).of(texts)
    monkeypatch.setattr(alignment, "REMEMBERED", 10)
    words = alignment.Words(left, right)
    parts = [words.of(texts[i:i + 5]).digests() for i in range(0, 50, 5)]
    assert [x for p in parts for x in p] == whole.digests()
