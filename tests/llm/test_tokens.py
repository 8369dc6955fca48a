import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from pergola.llm import bpe_codec, token_counts
from pergola.llm._bpe import merges

ENDED, SPACED = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LETTERS = list("abcXYZ  \n\t'sdtéÉßΣσİıǅ①½²٣中文字​́e\x85\xa0　\x1c\x1d_-.,!?0123😀<|>") + ["<|endoftext|>", "<|startoftext|>", "'ll", "<|ENDOFTEXT|>", "ﬁ"]


def texts(n=1500):
    rng = random.Random(2)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_counts_equal_the_library():
    library, own = Tokenizer.from_file(ENDED), token_counts._Counts(ENDED)
    for t in texts():
        assert own.text(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def ids_of(text, table):
    return [i for w in bpe_codec.words_of(text, table) for i in bpe_codec.word_ids(w, table)]


def test_ids_equal_the_library_and_decode_as_it_does():
    library, table = Tokenizer.from_file(SPACED), merges(SPACED)
    pieces = bpe_codec.Pieces(table)
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        assert ids_of(t, table) == ids, repr(t)
        assert pieces.text(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False) == t


def test_decoding_what_no_text_gives():
    pieces = bpe_codec.Pieces(merges(SPACED))
    library = Tokenizer.from_file(SPACED)
    for ids in ([130], [195, 130, 50256], [0, 220, 128]):
        assert pieces.text(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_numbers_survive_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5000):
        numbers = (2.0 ** (rng.random(n) * 28)).astype(np.uint32)
        assert (bpe_codec.unpacked(bpe_codec.packed(numbers)) == numbers).all()


def test_awkward_rows(spark, awkward):
    library = Tokenizer.from_file(ENDED)
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in awkward.collect()), key=repr)
    found = token_counts.count_tokens(awkward).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in found), key=repr) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in found) and any(r.over_limit for r in found)
    assert token_counts.count_tokens(awkward.limit(0)).count() == 0


def test_codec_on_awkward_rows(spark, awkward, monkeypatch):
    library = Tokenizer.from_file(SPACED)
    want = sorted(((r.doc_id, np.array(library.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes(), r.text or "") for r in awkward.collect()), key=repr)
    coded = bpe_codec.encode(awkward)
    back = bpe_codec.decode(coded)
    assert sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in back.collect()), key=repr) == want
    digest = {r.ids_sha256 for r in bpe_codec.digests(bpe_codec.encode(awkward, decoded=True)).collect()}
    assert digest == {hashlib.sha256(w[1]).hexdigest() for w in want}
    monkeypatch.setattr(bpe_codec, "PART_WORDS", 3)
    monkeypatch.setattr(bpe_codec, "RUN_WORDS", 7)
    assert sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in bpe_codec.encode(awkward, decoded=True).collect()), key=repr) == want
    assert bpe_codec.encode(awkward.limit(0)).count() == 0


def test_each_distinct_word_is_encoded_in_one_part(spark, awkward):
    blocks = bpe_codec._blocks(awkward.select("doc_id", "text"), SPACED).where("kind = 'words'")
    assert blocks.count() > 1
    parts = {}
    for r in bpe_codec.word_table(blocks, 5).collect():
        for w in bpe_codec._unbatch(bytes(r.words)).column("word").to_pylist():
            parts.setdefault(w, set()).add(r.part)
    assert all(len(p) == 1 for p in parts.values()) and len({min(p) for p in parts.values()}) == 5


def test_a_block_leaves_in_batches(monkeypatch):
    monkeypatch.setattr(bpe_codec, "OUT_BYTES", 2000)
    table, block = merges(SPACED), bpe_codec._Block()
    for k, t in enumerate(texts()):
        block.add(k, t, table)
    names = pa.schema([("block", pa.int64()), ("names", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("data", pa.binary()), ("n", pa.int64()), ("kind", pa.string())])
    docs, words = block.rows(names, 0).to_pylist()
    ids = [bpe_codec.word_ids(w, table) for w in bpe_codec._unbatch(words["data"]).column("word").to_pylist()]
    sizes = np.array([len(i) for i in ids])
    coded = {"block": 0, "numbers": bpe_codec.packed(np.diff(np.arange(len(ids)), prepend=0)), "sizes": bpe_codec.packed(sizes), "ids": bpe_codec.packed(np.concatenate(ids))}
    kinds = [*(names.field(c) for c in ("block", "names", "lengths", "data")), *(pa.field(c, pa.binary()) for c in ("numbers", "sizes", "ids"))]
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("decoded", pa.string())])
    rows = pa.Table.from_pylist([{f.name: r.get(f.name) for f in kinds} for r in (coded, docs)], pa.schema(kinds))
    found = list(bpe_codec.assembled(rows, bpe_codec.Pieces(table), out))
    assert len(found) > 20 and max(b.nbytes for b in found) < 8000
    assert [(r["doc_id"], r["decoded"]) for b in found for r in b.to_pylist()] == list(enumerate(texts()))
