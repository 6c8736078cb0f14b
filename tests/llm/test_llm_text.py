"""Quality rules, tokens and personal data against brute force, with nulls, empty, long, repeated and odd texts."""

import collections
import json
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from reasonset.llm import forced_bpe, pii, quality, token_store, word_memo  # noqa: E402
from reasonset.session import shared_folder  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, n_words string, `row` string, h string, `__t` string"


def odd_texts():
    random.seed(5)
    signs = list("abcXYZ  \n\t'st've1234½²³ÀéİΣςßŉǄ中文é　\x1c\x85​😀!!#$٣") + ["<|endoftext|>", "don't", "</w>", "+1 (269) 555-3296", " a.b@c.de", " 4111 1111 1111 1111"]
    return ["".join(random.choices(signs, k=random.randint(0, 60))) for _ in range(150)]


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", " \n\t ", "one", "the the the the the the the the the the", "a b c d e " * 30, "word " * 9 + "end of the line here", "x" * 200_000, "the of and " * 20_000, "line one\nline one\n\nline two\nline one"]
    texts += odd_texts()
    out = [(i, t, "s", "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    return [*out, out[4], out[4], (None, "no id at all", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, rows):
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], r["base_failed"]) for r in quality.measure(docs).collect())
    wanted = []
    for row in rows:
        counts = brute_counts(row[1])
        wanted.append((row[0] is None, row[0] or 0, *counts, counts[0] < 10 or 100 * counts[4] > 20 * counts[0]))
    assert found == sorted(wanted)


def test_quality_keeps_rows_as_they_are(docs):
    kept = quality.keep(docs)
    assert kept.schema == docs.schema
    ids = {r["doc_id"] for r in quality.measure(docs).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == ids
    assert all(r["n_words"] == "clash" for r in kept.collect())


def test_quality_of_no_rows(spark):
    assert quality.measure(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tokens_agree_with_the_library(spark, docs, rows):
    library = Tokenizer.from_file(PATH)
    encoded = {(r[0], r[1]): library.encode(r[1] or "", add_special_tokens=False).ids for r in rows}
    decoded = forced_bpe.decode(forced_bpe.encode(docs, PATH), PATH).collect()
    assert len(decoded) == len(rows)
    assert sorted(map(repr, forced_bpe.round_trip(docs, PATH).collect())) == sorted(map(repr, decoded))
    texts = {r[0]: r[1] for r in rows}
    for r in decoded:
        ids = encoded[r["doc_id"], texts[r["doc_id"]]]
        assert r["ids"] == ids
        assert r["text"] == library.decode(ids, skip_special_tokens=False)
    folder = shared_folder(spark, "tokens")
    token_store.write_tokens(docs, folder, PATH, block_ids=500)
    stored = token_store.read_tokens(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in stored] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    position, every = 0, []
    for r in stored:
        ids = [*encoded[r["doc_id"], texts[r["doc_id"]]], 2]
        assert (r["start"], zlib.crc32(r["ids"])) == (position, zlib.crc32(np.array(ids, "<u4").tobytes()))
        position, every = position + len(ids), every + ids
    for at in (0, 1, position // 3, position - 1):
        assert token_store.tokens_at(spark, folder, at) == every[at]
    assert token_store.tokens_at(spark, folder, position) is None


def test_tokens_of_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    folder = shared_folder(spark, "tokens")
    token_store.write_tokens(empty, folder, PATH)
    assert token_store.read_tokens(spark, folder).collect() == []
    assert forced_bpe.decode(forced_bpe.encode(empty, PATH), PATH).collect() == []


@pytest.mark.parametrize("high", [1, 200, 256, 70_000, 1 << 31])
def test_codes_give_any_place(high):
    ids = np.random.default_rng(high).integers(0, high, 3000).astype(np.uint32)
    codes = token_store.Codes.of(ids)
    assert (codes.at(np.arange(3000)) == ids).all()
    assert all(codes.at(np.array([i]))[0] == ids[i] for i in (0, 7, 511, 512, 513, 2047, 2999))


def test_forced_cuts_never_change_the_result():
    library, memo = Tokenizer.from_file(PATH), forced_bpe.forced_encoder(PATH)
    for text, ids in zip(odd_texts(), memo.encode(odd_texts())):
        assert list(ids) == library.encode(text, add_special_tokens=False).ids


def test_chunks_cut_as_the_library_does():
    """One text at a time, so that an added token in one does not keep the others from being cut finely."""
    random.seed(6)
    parts = ["it's", "'s", "!'s", "A1b2", "x\u00a0y", "\u2003", "\x1c", "\x85", "é", "=\u0338", "H\u0331", "I\u0307", "İ", "ſ", "\u212a", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>b", " ", "\n", "\x00", "é,", "𝄞", "1,000.50", "Σ", "'", "''ll", "\u200b", "\u3000"]
    library = Tokenizer.from_file(PATH)
    for encoder in (token_store.library_encoder(PATH), forced_bpe.forced_encoder(PATH)):
        for _ in range(1500):
            text = "".join(random.choices(parts, k=random.randint(0, 12)))
            assert list(encoder.encode([text])[0]) == library.encode(text, add_special_tokens=False).ids


def test_memory_is_bounded_and_changes_nothing():
    encoder = forced_bpe.forced_encoder(PATH)
    small = word_memo.WordMemo(encoder.resolve, "<u4", ["<|endoftext|>", "<|startoftext|>"], generation=100_000)
    random.seed(7)
    texts = [" ".join("".join(random.choices("abcde", k=random.choice([1, 2, 7]))) for _ in range(200)) for _ in range(60)]
    for k in range(0, 60, 5):
        assert [list(x) for x in small.encode(texts[k : k + 5])] == [list(x) for x in encoder.encode(texts[k : k + 5])]
        assert len(small.young) + len(small.old) < 2 * (100_000 // word_memo.ENTRY + 2)
    assert b"a" in small.young or b"a" in small.old
    assert small.encode([]) == [] and [len(x) for x in small.encode(["", " "])] == [0, 0]


def test_other_tokenizers(tmp_path):
    """A file that writes words in another way goes through the library whole, and has no forced cuts."""
    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["normalizer"] = None
    path = str(tmp_path / "other.json")
    open(path, "w", encoding="utf-8").write(json.dumps(spec))
    library = Tokenizer.from_file(path)
    for text, ids in zip(odd_texts(), token_store.library_encoder(path).encode(odd_texts())):
        assert list(ids) == library.encode(text, add_special_tokens=False).ids
    with pytest.raises(ValueError):
        forced_bpe.forced_encoder(path)


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            sound = (True, kind == 1 and all(int(p) <= 255 for p in m[0].split(".")), 14 <= len(digits) <= 19 and pii.luhn(digits), 10 <= len(digits) <= 15)[kind]
            out += [(m.start(), m.end(), kind)] if sound else []
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_are_those_of_the_patterns():
    random.seed(1)
    for _ in range(20_000):
        text = "".join(random.choices("ab12345678900.@+-() %_\n,é09.@", k=random.randint(0, 40)))
        assert sorted(pii.base_spans(text), key=lambda s: (s[0], s[2])) == plain_spans(text)


def test_base_spans_of_long_runs_are_fast():
    for text in ("1" * 300_000, "a" * 300_000, "1." * 100_000, "@" * 100_000, "+1" * 100_000, "a@" * 100_000, "1 " * 100_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def field(spark, sf_dir):
    return pii.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_field_agrees_with_patterns_on_held_out_words(spark, sf_dir, field):
    """Most labelled words of documents outside the sample get their labels back, plain documents get none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 3 = 0").collect()
    right = total = 0
    for row in docs:
        for shapes, labels in pii.labelled(row["text"] or ""):
            scores = np.array([[field.scores(*shapes[t : t + 3]) for t in range(len(labels))]])
            path = pii.viterbi(scores, field.moves)[0].tolist()
            total += sum(x > 0 for x in labels)
            right += sum(x == y > 0 for x, y in zip(path, labels))
    assert total and right / total > 0.9


def test_field_adds_spans_that_run_together(spark, sf_dir):
    field = pii.fit(spark.read.parquet(f"{sf_dir.replace('0.01', '0.1')}/documents.parquet"))
    text = "call +1 (269) 555-3296 4524132264652876 now"
    (base, every), = pii.all_spans([text], field)
    assert base == [] and every == [(5, 22, 3), (23, 39, 2)]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    scores, moves = rng.normal(size=(5, 3, pii.LABELS)), rng.normal(size=(pii.LABELS, pii.LABELS))
    paths = [(a, b, c) for a in range(pii.LABELS) for b in range(pii.LABELS) for c in range(pii.LABELS)]
    for one, found in zip(scores, pii.viterbi(scores, moves)):
        best = max(paths, key=lambda p: moves[0, p[0]] + sum(one[t, p[t]] for t in range(3)) + moves[p[0], p[1]] + moves[p[1], p[2]] + moves[p[2], 0])
        assert tuple(found) == best


def test_find_and_redact(spark, docs, rows, field):
    texts = {r[0]: r[1] for r in rows}
    found = pii.find(docs, field).collect()
    assert len(found) == len(rows)
    for r in found:
        base = plain_spans(texts[r["doc_id"]] or "")
        assert r["base"] == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in base)
        assert set(filter(None, r["base"].split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == i for s in base) for i in range(4)]
    done = pii.redact(docs, field)
    assert done.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in done.collect()) == collections.Counter(r[0] for r in rows)
    assert all(r["text"] is None for r in done.collect() if r["doc_id"] == 0)
    assert not any(re.search(PATTERNS[0], r["text"] or "") for r in done.collect())


def test_personal_data_without_training_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pii.fit(empty) is None
    assert pii.find(empty, None).collect() == [] and pii.redact(empty, None).collect() == []
    plain = spark.createDataFrame([(1, "no numbers", "s", "", "", "", "")], SCHEMA)
    assert pii.fit(plain) is None
    assert hashlib.sha256(pii.find(plain, None).first()["base"].encode()).hexdigest() == hashlib.sha256(b"").hexdigest()


def test_bulk_reads_use_the_rank_directory():
    ids = np.random.default_rng(4).integers(0, 49_000, 20_000).astype(np.uint32)
    codes = token_store.Codes.of(ids)
    assert (codes.at(np.arange(len(ids))) == ids).all()
    codes.ranks[0][5] -= 1
    wrong = np.flatnonzero(codes.at(np.arange(len(ids))) != ids)
    assert len(wrong) and set(wrong // token_store.RANK_BITS) == {5}


def test_shapes_of_long_words_and_distant_neighbours():
    """Long words and neighbours beyond long white space count whole."""
    from reasonset.llm import pii

    assert pii.shape("a" * 100 + "1") == "xd" and pii.shape("a" * 100 + "@b") == "x@x"
    gap = " " * 500
    ((places, shapes),) = pii.runs(f"Before{gap}12{gap}{'z' * 200}.")
    assert [len(places), *shapes] == [1, "capital", "dd", "lower+"]
    ((_, shapes),) = pii.runs(f"{gap}12{gap}")
    assert shapes == [pii.BORDER, "dd", pii.BORDER]
