"""The pipeline against a brute-force version of its stages."""

import random

import sentencepiece

import corpus_pipeline
from seqframe.llm import mixing, piece_scan, suffix_dedup
from tests.llm.test_operators import brute_cut, near_groups

RNG = random.Random(21)
PARTS = {"en": ["th", "ing", "er", "and", "ou"], "de": ["sch", "ung", "ein", "ich", "ü"]}


def prose(n, lang):
    return " ".join("".join(RNG.choices(PARTS[lang], k=RNG.randint(1, 4))) for _ in range(n))


def test_pipeline(spark, tmp_path):
    passage = prose(100, "en")[:450]
    rows = []
    for i in range(40):
        lang = "de" if i % 3 == 0 else "en"
        rows.append((i, prose(RNG.randint(70, 200), lang), lang, f"s{i % 4}"))
    rows += [(40, rows[1][1], "en", "s0"), (41, "12 34 !?", "en", "s1"), (42, None, "de", "s1"), (43, "", None, "s2")]
    rows += [(44 + i, prose(60, "en") + "\n" + passage + "\n" + prose(60, "en"), "en", "s3") for i in range(3)]
    rows = [(*r, len(r[1] or "")) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    docs = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    groups = near_groups({r[0]: tuple(r[1].encode().lower().split()) for r in docs})
    docs = [r for r in docs if groups[r[0]] == r[0]]
    data = [r[1].encode() for r in docs]
    from collections import Counter

    size = suffix_dedup.PASSAGE
    seen = Counter(t[i : i + size] for t in data for i in range(len(t) - size + 1))
    cut = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        cut.append(bytes(c for c, g in zip(t, gone) if not g).decode("utf-8", "ignore"))
    assert sum(n for _, n, _, _ in brute_cut(data, size)) >= 3 * 450
    docs = [(r[0], t, r[2], r[3], len(t)) for r, t in zip(docs, cut)]
    kept = {r["doc_id"] for r in mixing.mix(spark.createDataFrame(docs, schema)).where("kept").collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=piece_scan.model_path())
    assert got == {r[0]: model.encode(r[1]) for r in docs if r[0] in kept}
