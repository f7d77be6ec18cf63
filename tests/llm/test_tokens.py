"""Chunked encoding, packing, id planes and speculative BPE against the tokenizers library."""

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tests.llm.helpers import PROSE, documents, odd_documents
from visitweave.llm import packing as P, planes as B, speculative_bpe as S
from visitweave.llm.common import fresh_path
from visitweave.llm.token_ids import ChunkEncoder, public_path

ODD = "aabbccdeeeéäßΣσςİIıǅ１²½٣五,.'!’<|>_-\t\n\r\x0b\x1c\x1f\x85\xa0  　́​😀ﬁÅ"


def library(name):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_path(name))


def plain_ids(tokenizer, text, *end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, *end], "<u4")


def odd_texts(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(ODD) for _ in range(draw.randrange(1, 60))) for _ in range(n)] + [
        None, "", " ", "<|endoftext|>", "x <|endoftext|> y's", "<|endoftext|><|startoftext|>a", "aaaa" * 300, "a  b\n c "]


def test_chunks_give_the_ids_of_whole_texts():
    tokenizer, encoder = library(P.TOKENIZER), ChunkEncoder(public_path(P.TOKENIZER), known=50)
    texts = odd_texts(1500, 1)
    for _ in range(2):   # with nothing known, then with a full memory
        assert encoder(texts) == [plain_ids(tokenizer, x).tobytes() for x in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40))
def test_chunks_on_any_text(text):
    assert ENCODER([text])[0] == plain_ids(LIBRARY, text).tobytes()


LIBRARY, ENCODER = library(P.TOKENIZER), ChunkEncoder(public_path(P.TOKENIZER))


def test_speculation_gives_what_merging_gives():
    tokenizer, bpe = library(S.TOKENIZER), S.SpeculativeBpe(public_path(S.TOKENIZER), known=50)
    draw = random.Random(5)
    words = ["".join(draw.choice("etaoinshrdlu") for _ in range(draw.randrange(1, 25))) for _ in range(5000)]
    texts = odd_texts(1500, 2) + [" ".join(words[i:i + 100]) for i in range(0, 5000, 100)]
    for _ in range(2):
        for text, (ids, decoded) in zip(texts, bpe(texts)):
            want = plain_ids(tokenizer, text)
            assert ids == want.tobytes(), text
            assert decoded.decode() == tokenizer.decode(want.tolist(), skip_special_tokens=False)


def test_every_character_has_the_ids_of_the_library():
    """Newest characters included, which Python's tables don't know: alone, amid a word, and before a mark that moves."""
    tokenizer, bpe = library(S.TOKENIZER), S.SpeculativeBpe(public_path(S.TOKENIZER), known=0)
    codes = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and not 0x3400 <= i < 0x9FFF
             and not 0xAC00 <= i < 0xD7A0 and not 0x20000 <= i < 0x2FA00 and not 0x30000 <= i < 0x31300
             and not (0x33000 <= i < 0xE0000 and i % 997) and not (i > 0xE1000 and i % 997)]
    texts = [t for i in codes for t in (f"A{chr(i)}b {chr(i)}", f"e{chr(i)}\u0301X")]
    for at in range(0, len(texts), 4096):
        part = texts[at:at + 4096]
        got = [ids for ids, _ in bpe(part)]
        want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(part, add_special_tokens=False)]
        assert got == want, [t for t, g, w in zip(part, got, want) if g != w][:5]


def test_marks_come_from_the_file(tmp_path):
    import json
    with open(public_path(S.TOKENIZER), encoding="utf-8") as f:
        spec = json.load(f)
    for x, name in zip(spec["added_tokens"], ("[START]", "{END}")):
        spec["model"]["vocab"][name] = spec["model"]["vocab"].pop(x["content"], x["id"])
        x["content"] = name
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    from tokenizers import Tokenizer
    tokenizer, bpe = Tokenizer.from_file(str(path)), S.SpeculativeBpe(str(path))
    for text in ("a [START]b{END}", "{END}", "[start] x", "<|endoftext|>"):
        ids, decoded = bpe([text])[0]
        want = plain_ids(tokenizer, text)
        assert ids == want.tobytes() and decoded.decode() == tokenizer.decode(want.tolist(), skip_special_tokens=False)


def test_greedy_guesses_do_fail_and_are_caught():
    vocabulary = S.SpeculativeBpe(public_path(S.TOKENIZER)).vocabulary
    words = ["".join(random.Random(i).choices("etaoinshrdlu", k=12)) for i in range(2000)]
    wrong = [w for w in words if vocabulary.guess(w) != vocabulary.merge(w)]
    assert wrong and vocabulary.encode(words) == [vocabulary.merge(w) for w in words]


@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=2), st.text("abc", min_size=1, max_size=2)), max_size=12),
       st.text("abc", min_size=1, max_size=14))
@settings(max_examples=300, deadline=None)
def test_compatibility_on_small_vocabularies(wanted, word):
    """With any merges whose parts exist, guess and verify equals exact merging."""
    tokens = {x: i for i, x in enumerate([*"abc", "a$", "b$", "c$"])}
    merges = []
    for a, b in wanted:
        b = b + "$" if len(b) == 2 else b
        if a in tokens and b in tokens and a + b not in tokens:
            tokens[a + b] = len(tokens)
            merges.append((a, b))
    vocabulary = S.Vocabulary(tokens, merges, "$")
    assert vocabulary.encode([word]) == [vocabulary.merge(word)]


def test_digests(spark):
    tokenizer, df = library(S.TOKENIZER), odd_documents(spark)
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in S.digests(df).collect())
    want = []
    for row in df.collect():
        ids = plain_ids(tokenizer, row.text)
        text = tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        want.append((len(ids), sha256(ids.tobytes()).hexdigest(), sha256(text.encode()).hexdigest()))
    assert got == sorted(want) and S.digests(df.limit(0)).count() == 0


def check_pieces(df, pieces, end):
    want = {}
    for row in df.collect():
        want.setdefault(row.doc_id, []).append(plain_ids(LIBRARY, row.text, end))
    total = sum(len(x) for own in want.values() for x in own)
    assert sum(p.length for p in pieces) == total
    for p in pieces:
        assert any(p.doc_tokens == len(ids) and p.ids_crc32 == crc32(ids[p.start:p.start + p.length].tobytes()) for ids in want[p.doc_id])
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= P.SEQUENCE_TOKENS and len(own) <= P.SEQUENCE_SEGMENTS
    return by_sequence


def test_packed_documents(spark):
    df = odd_documents(spark)
    check_pieces(df, P.pack_documents(df).collect(), P.END_ID)
    assert P.pack_documents(df.limit(0)).count() == 0


def test_packing_wastes_little(spark, sf):
    pieces = P.op2_vector_packing(spark, sf).collect()
    found = check_pieces(spark.read.parquet(f"{sf}/documents.parquet"), pieces, P.END_ID)
    assert sum(p.length for p in pieces) > 0.985 * P.SEQUENCE_TOKENS * len(found)


def plain_fill(demands, limits):
    """The dot-product heuristic, example by example."""
    share, left, out = demands / limits, list(range(len(demands))), []
    while left:
        room, own = np.ones(demands.shape[1]), []
        while fits := [i for i in left if (share[i] <= room + 1e-9).all()]:
            best = max(fits, key=lambda i: (round(share[i] @ room, 12), *share[i]))
            own.append(tuple(demands[best]))
            left.remove(best)
            room = room - share[best]
        out.append(sorted(own))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_fill_is_the_dot_product_heuristic(seed):
    draw = np.random.default_rng(seed)
    demands = np.stack([draw.integers(1, 100, 60), np.ones(60, int), draw.integers(0, 50, 60)], 1).astype(float)
    limits = np.array([128.0, 4.0, 60.0])
    sequence, turn = P.fill(demands, limits)
    got = [[tuple(x) for x in demands[sequence == s]] for s in range(sequence.max() + 1)]
    assert sorted(map(sorted, got)) == plain_fill(demands, limits)
    assert all((demands[sequence == s].sum(0) <= limits).all() for s in range(sequence.max() + 1))


def test_examples_larger_than_a_sequence_are_refused(spark):
    df = spark.createDataFrame([(1, 5, 9)], "id long, n long, sequence_id long")
    with pytest.raises(Exception, match="larger than a sequence"):
        P.pack(df, {"n": 4}, "n", ["id"]).collect()
    assert P.pack(df, {"n": 5}, "n", ["id"]).first().offset == 0


def test_conversations_are_limited_on_all_three(spark, sf):
    items = P.conversation_items(spark.read.parquet(f"{sf}/conversations.parquet"))
    fits = items.filter("tokens <= 4096 and segments <= 16 and loss_tokens <= 1500")
    got = P.pack(fits, {"tokens": 4096, "segments": 16, "loss_tokens": 1500}, "tokens", ["conv_id"]).toPandas()
    sums = got.groupby("sequence_id")[["tokens", "segments", "loss_tokens"]].sum()
    assert (sums <= [4096, 16, 1500]).all().all() and len(got) == fits.count()


def test_long_conversations_are_cut_and_nothing_is_lost(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", PROSE * (c % 4)) for c in range(40) for t in range(c % 5 + 1)]
    rows += [(100, 0, "assistant", "word " * 9000), (101, None, None, None), (None, 3, "user", "nobody's"), (None, 4, "assistant", "x")]
    rows += [(102, t, "assistant", PROSE) for t in range(90)] + [(103, 0, "user", "y " * 3000), (103, 0, "user", "y " * 3000)]
    turns = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, tokens int, part string")
    limits = {"tokens": 512, "segments": 10, "loss_tokens": 200}
    got = P.pack_conversations(turns, limits=limits).toPandas()
    sums = got.groupby("sequence_id")[list(limits)].sum()
    assert (sums <= list(limits.values())).all().all()
    want: dict = {}
    for conv, _, role, text in rows:
        n = len(plain_ids(LIBRARY, text, 2))
        a = want.setdefault(conv, [0, 0])
        a[0] += n
        a[1] += n * (role == "assistant")
    found = got.groupby("conv_id", dropna=False)[["tokens", "loss_tokens"]].sum()
    assert {None if c != c else int(c): [int(x) for x in v] for c, v in zip(found.index, found.to_numpy())} == want
    ordered = got.sort_values(["sequence_id", "offset"])
    for _, own in ordered.groupby("sequence_id"):
        assert own.offset.tolist() == (own.tokens.cumsum() - own.tokens).tolist()
    assert P.pack_conversations(turns.limit(0)).count() == 0


def test_conversations_of_the_table_fill_their_sequences(spark):
    got = P.packed_conversations(spark, "/root/testdata/sf0.01").toPandas()
    assert got.conv_id.nunique() == 100 and (got.part == "0").mean() > 0.5
    sums = got.groupby("sequence_id")[list(P.DIALOGUE_LIMITS)].sum() / list(P.DIALOGUE_LIMITS.values())
    assert sums.max(axis=None) <= 1 and (sums.max(axis=1) > 0.8).mean() > 0.8      # some limit is nearly reached
    assert (sums > 0.9).any().all()                                              # each of them somewhere


@pytest.mark.parametrize("kind", [B.BYTES, B.BITS])
def test_planes_round_trip(spark, kind):
    df = odd_documents(spark)
    manifest = B.write_ids(df, fresh_path(spark, "planes"), kind=kind, block=1000, range_bytes=2000)
    got = sorted(B.read_ids(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10, None]
    start, texts = 0, {r.doc_id: r.text for r in df.collect()}
    for r in got:
        ids = plain_ids(LIBRARY, texts[r.doc_id], B.END_ID)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc32(ids.tobytes()))
        start += len(ids)
    empty = B.write_ids(df.limit(0), fresh_path(spark, "planes"))
    assert B.read_ids(empty).count() == 0


@pytest.mark.parametrize("kind", [B.BYTES, B.BITS])
@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_transposition(kind, n):
    values = np.random.default_rng(n).integers(0, 1 << 32, n).astype("<u4")
    if n:
        assert (B.from_planes(B.to_planes(values, kind), n, kind, "<u4") == values).all()


def test_any_chunk_can_be_read(tmp_path):
    ids = np.arange(2500, dtype="<u4")
    with open(tmp_path / "f", "wb") as f:
        writer = B.PlaneWriter(f, B.BITS, block=1000)
        writer.add(1, ids[:1700].tobytes())
        writer.add(2, ids[1700:].tobytes())
        writer.close()
    from visitweave.llm.files import open_file
    with open_file(str(tmp_path / "f")) as source:
        reader = B.PlaneReader(source)
        assert reader.chunks == 3 and (reader.chunk(1) == ids[1000:2000]).all() and (reader.chunk(2) == ids[2000:]).all()
        assert reader.documents() == [(1, 1700), (2, 800)]


def test_ids_of_documents_in_any_order(spark):
    df = documents(spark, [(i, f"text {i}") for i in (30, 10, 20, -5)])
    got = B.read_ids(B.write_ids(df, fresh_path(spark, "planes"), range_bytes=50)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [-5, 10, 20, 30]


@pytest.mark.parametrize("range_bytes", [1 << 24, 3000])
def test_a_range_fills_several_files(spark, range_bytes):
    rows = [(i, " ".join(f"w{i}" for _ in range(1 + i % 7))) for i in range(300)]
    manifest = B.write_ids(documents(spark, rows), fresh_path(spark, "planes"), range_bytes=range_bytes, file_ids=100)
    files = manifest.orderBy("_range", "_file").collect()
    sizes = [r.n_ids for r in files]
    ranges = len({r._range for r in files})
    assert all(100 <= n < 140 for f, n, g in zip(files, sizes, files[1:]) if f._range == g._range) and len(files) > 3 * ranges
    assert (ranges == 1) == (range_bytes > 3000)
    got, start = B.read_ids(manifest).orderBy("start").collect(), 0
    assert [r.doc_id for r in got] == list(range(300)) and sum(sizes) == sum(r.n_tokens for r in got)
    for r in got:
        ids = plain_ids(LIBRARY, rows[r.doc_id][1], B.END_ID)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc32(ids.tobytes()))
        start += len(ids)
