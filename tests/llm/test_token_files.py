import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from sparkwarden.llm.queries import op10_token_files
from sparkwarden.llm.token_files import SequenceFile, read_documents, write_token_files

PATH = P.path("byte_bpe_50k.json")


def test_round_trip(spark, tmp_path):
    texts = [None, "", "It's  naïve\n\n日本 x\x00y <|endoftext|>", "a b " * 3000, "same", "same", "word" * 2000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, "same"), (None, "last")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    manifest = write_token_files(df, PATH, str(tmp_path), sequence=64, batch=4)
    got = sorted((r for r in read_documents(manifest).collect()), key=lambda r: r.start)
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    want = sorted(((i if i is not None else -1, t or "") for i, t in rows), key=lambda r: r[0])
    ids = [library.encode(t, add_special_tokens=False).ids + [2] for _, t in want]
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 4, 4, 5, 6]
    assert [r.n_tokens for r in got] == [len(x) for x in ids]
    assert [r.start for r in got] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(x, "<u4")) for x in ids]
    whole = []
    for r in sorted(manifest.collect(), key=lambda r: r.shard):
        file = SequenceFile(r.path)
        assert len(file) == r.n_sequences
        for k in range(len(file)):
            one, mask = file[k]
            assert len(one) == len(mask) == 64 and not one.flags.owndata
            whole += one[np.array(mask.to_pylist())].tolist()
    assert whole == [i for x in ids for i in x]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert read_documents(write_token_files(df, PATH)).count() == 0


def test_added_tokens_as_in_the_library(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "é <|endoftext| >", "日本<|endoftext|>", None])], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()}
    library = Tokenizer.from_file(PATH)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in docs.items()}
    assert 50256 in ids[0]
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in op10_token_files(spark, str(tmp_path)).collect()}
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4"))) for i, x in ids.items()}
