"""Toxicity, quality, token counts, piece encoding and the pipeline."""

import functools
import math
import random
import struct

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from graphloom.llm import pieces, piece_fst, quality, token_counts, toxicity
from graphloom.llm.boosting import isotonic

DOCS = "doc_id bigint, text string"
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize(("score", "label", "least"), [(toxicity.score_toxicity, "toxic", 0.93), (quality.score_quality, "quality", 0.97)])
def test_classifiers_on_held_out_rows(tables, score, label, least):
    docs, labels = tables
    scored = score(docs, labels)
    assert scored.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = scored.join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert 50 < len(held) < len(rows)
    assert np.mean([r.predicted == r[label] for r in held]) >= least
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


@pytest.mark.parametrize(("score", "label"), [(toxicity.score_toxicity, "toxic"), (quality.score_quality, "quality")])
def test_labels_of_held_out_rows_teach_nothing(tables, score, label):
    docs, labels = tables
    modulus, fold = (3, 1) if label == "toxic" else (4, 2)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == fold
    flipped = labels.withColumn(label, F.when(held, 1 - F.col(label)).otherwise(F.col(label)))
    a = {r.doc_id: r.score for r in score(docs.limit(60), labels).collect()}
    b = {r.doc_id: r.score for r in score(docs.limit(60), flipped).collect()}
    assert a == b


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_classifiers_on_odd_tables(spark, tables, score):
    docs, labels = tables
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "x" * 200_000), (5, "word " * 40_000), (6, "é€𝄞!!!"), (None, "null id"), (2, "")]
    odd = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], DOCS + ", score int, y string")
    nulls = spark.createDataFrame([(None, 1, 0), (1, None, None), (99, 1, 1), (1, 1, 0), (1, 0, 1)], "doc_id bigint, quality int, toxic int")
    for known in (nulls, nulls.limit(0)):
        got = score(odd, known).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert score(odd.limit(0), labels).count() == 0


def test_toxic_forms_that_were_not_seen_whole():
    lexicon = toxicity.Lexicon({"=idiot": 5.0, "idio": 5.0, "lowei": 4.0})
    assert lexicon.weight("idiotic") == 5.0 and lexicon.weight("loweiburg") == 4.0 and lexicon.weight("lower") == 0.0
    named = dict(zip(toxicity.FEATURES, toxicity.features("You are an 1d10t, you i d i o t and i.d.i.o.t", lexicon), strict=True))
    assert named["listed masked words"] == 3 and named["best entry"] == 5.0
    assert toxicity.features("", lexicon)[0] == 0.0


def test_isotonic_is_the_pooled_step_function():
    at, p = isotonic(np.array([1.0, 2, 3, 4, 5, 6]), np.array([0, 0, 1, 0, 1, 1]))
    assert (np.diff(p) >= 0).all() and np.interp(0, at, p) < 0.3 and np.interp(9, at, p) > 0.7


def test_factorisation_identity():
    machine = quality.FactorisationMachine()
    rng = np.random.default_rng(0)
    machine.v, machine.w, machine.bias = rng.normal(size=machine.v.shape), rng.normal(size=machine.w.shape), 0.3
    at, x = rng.choice(len(machine.w), 12, replace=False), rng.normal(size=12)
    margin, _ = machine._margin(at, x, np.array([0]))
    pairs = sum(machine.v[at[i]] @ machine.v[at[j]] * x[i] * x[j] for i in range(12) for j in range(i))
    assert np.isclose(margin[0], 0.3 + machine.w[at] @ x + pairs)


# Pieces


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(pieces.read_model())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)


def strings(n=1500):
    rng = random.Random(3)
    alphabet = "aabcdeeehtion   \n\té€𝄞=().,:;\"'<>/0123  ▁{}"
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(n)] + ["", " ", "  ", "\n", "▁", "a" * 3000, " " * 100, "  " + "x" * 20_000, " " * 5000, "   the  theand " * 200, "  " + "einheitkeiten" * 40, "the " * 500]


def test_encoding_is_the_librarys(model, library, tables):
    transducer = piece_fst.PieceTransducer(model)
    texts = strings() + [r.text for r in tables[0].limit(80).collect()]
    assert [transducer.encode(t) for t in texts] == library.encode(texts)
    assert [model.decode(i) for i in library.encode(texts)] == [library.decode(i) for i in library.encode(texts)]


@functools.lru_cache(maxsize=None)
def paths(text):
    """Every way to cut a short text into spans."""
    return [[]] if not text else [[text[:k], *rest] for k in range(1, len(text) + 1) for rest in paths(text[k:])]


def best(model, text):
    cost = lambda parts: sum(model.scores.get(p, model.unknown_score if len(p) == 1 else -np.inf) for p in parts)
    return max(paths(text), key=cost), max(map(cost, paths(text)))


def test_unigram_models_take_the_best_path(model):
    unigram = pieces.PieceModel(pieces.read_model())
    unigram.kind = pieces.UNIGRAM
    transducer, trie = piece_fst.PieceTransducer(unigram), token_counts.CountingTrie(unigram)
    for text in ["theand", "hello", "einheit", "ab€𝄞c", "xyzzy", "the", "qqqq", "ñandú", "1234"]:
        _, score = best(unigram, transducer.normaliser(text))
        ids = transducer.encode(text)
        normal = [i for i in ids if unigram.kinds[i] == pieces.NORMAL]
        unknown = sum(1 for c in transducer.normaliser(text) if c not in unigram.scores)
        assert np.isclose(sum(unigram.scores[unigram.pieces[i]] for i in normal) + unknown * unigram.unknown_score, score)
        assert trie.count(text)[0] == len(ids)
        assert unigram.decode(ids) == text


def test_counts_share_prefixes_and_survive_a_full_trie(model, monkeypatch):
    texts = strings(300)
    whole = token_counts.CountingTrie(model)
    want = [whole.count(t) for t in texts]
    assert len(whole.tokens) < sum(len(p) for t in texts for p in whole.machine.pretokens(t))
    monkeypatch.setattr(token_counts, "MOST_NODES", 200)
    small = token_counts.CountingTrie(model)
    assert [small.count(t) for t in texts] == want and len(small.tokens) < 2000


def test_counts_are_the_librarys(model, library, tables):
    trie = token_counts.CountingTrie(model)
    texts = strings(300) + [r.text for r in tables[0].collect()]
    assert [trie.count(t)[0] for t in texts] == [len(ids) for ids in library.encode(texts)]


def unigram_file() -> bytes:
    """The model file as a unigram model, its scores the logarithms of falling shares by rank."""
    def varint(n):
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    out, rank = b"", 0
    parts = []
    for number, value in pieces._fields(pieces.read_model()):
        if number == 1:
            fields = dict(pieces._fields(value))
            if fields.get(3, pieces.NORMAL) == pieces.NORMAL:
                rank += 1
                new = b"\x15" + struct.pack("<f", -math.log(rank + 2.7))
                value = value.replace(b"\x15" + fields[2], new, 1) if 2 in fields else value + new
        elif number == 2:
            value = value.replace(b"\x18\x02", b"\x18\x01", 1)
        parts.append(bytes([number << 3 | 2]) + varint(len(value)) + value)
    return out.join(parts)


def test_unigram_encoding_and_counts_are_the_librarys(tables):
    """But for ways of equal score, where the library's single precision decides."""
    file = unigram_file()
    unigram, library = pieces.PieceModel(file), sentencepiece.SentencePieceProcessor(model_proto=file)
    transducer, trie = piece_fst.PieceTransducer(unigram), token_counts.CountingTrie(unigram)
    texts = strings(100) + [r.text for r in tables[0].limit(300).collect()]
    got, want = [transducer.encode(t) for t in texts], library.encode(texts)
    score = lambda ids: sum(unigram.scores.get(unigram.pieces[i], 0.0) for i in ids)
    assert np.mean([a == b for a, b in zip(got, want, strict=True)]) > 0.95
    assert all(a == b or score(a) >= score(b) - 1e-6 for a, b in zip(got, want, strict=True))
    assert [trie.count(t)[0] for t in texts] == [len(ids) for ids in got]


def test_piece_queries_on_odd_tables(spark, model):
    rows = [(1, None), (2, ""), (3, " "), (4, "x" * 100_000), (5, "é€𝄞 " * 5000), (None, "null id"), (2, ""), (7, "▁a")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS + ", n_tokens int, piece_ids string")
    counts = token_counts.count_tokens(df).collect()
    assert len(counts) == len(rows) and [r.n_tokens for r in counts if r.doc_id in (1, 2)] == [0, 0, 0]
    encoded = piece_fst.encode_documents(df)
    assert all(r.restored and r.n_pieces == len(r.piece_ids) for r in encoded.collect())
    back = {r.doc_id: r.text for r in piece_fst.decode_pieces(encoded).collect()}
    assert back[4] == rows[3][1] and back[5] == rows[4][1] and back[1] == "" and back[7] == " a"
    assert token_counts.count_tokens(df.limit(0)).count() == 0 and piece_fst.encode_documents(df.limit(0)).count() == 0


# Pipeline


def test_pipeline_stage_by_stage(spark, tables):
    import corpus_pipeline

    from graphloom.llm.secrets import scan_secrets

    docs, _ = tables
    kept = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        before = list(kept.values())[-1]
        kept[name] = corpus_pipeline.materialize(stage(spark, before, SF))
        if stage is not corpus_pipeline.pieces:
            assert kept[name].columns == docs.columns
    good, single, clean, mixed, encoded = list(kept.values())[1:]
    assert 0.8 < good.count() / docs.count() < 0.95
    texts = [" ".join(r.text.lower().split()) for r in single.collect()]
    assert len(texts) == len(set(texts)) and single.count() < good.count()
    found = scan_secrets(clean)
    assert found.agg(F.sum(F.col("n_assign") + F.col("n_access") + F.col("n_hex"))).first()[0] == 0
    assert clean.count() == single.count() and mixed.select("doc_id").distinct().count() <= clean.count()
    assert encoded.count() == mixed.count() and encoded.where("not restored").count() == 0
    whole = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.piece_ids) for r in whole.collect()) == sorted((r.doc_id, r.piece_ids) for r in encoded.collect())


def test_pipeline_keeps_extra_columns_and_odd_rows(spark, tables):
    import corpus_pipeline

    docs, _ = tables
    odd = spark.createDataFrame([(None, None, None, None, None), (900_001, None, "en", None, 0), (900_002, "", "en", "x", 0), (900_002, "", "en", "x", 0)], docs.schema)
    rows = docs.limit(100).unionAll(odd).withColumns({"h": F.lit(1), "__base": F.lit("x"), "lanes": F.lit(2)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.columns == rows.columns and out.count() > 0
        assert stage(spark, rows.limit(0), SF).count() == 0
