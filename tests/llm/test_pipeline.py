"""The pipeline against a run of brute-force stages."""

import base64
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

import cases
import corpus_pipeline
from paperlode.llm import quality_rules


def fixture(rng):
    passage = "\n".join(cases.prose(rng, 12, 10**6) for _ in range(6))
    rows = []
    for i in range(120):
        text = "the of and " + cases.prose(rng, rng.choice([4, 80, 200]), 10**6)
        if i % 7 == 0:
            text += "\n" + passage
        if i % 11 == 0:
            text = "spam again " * 30
        rows.append((i, text, ["b", "a", None][min(i % 5, 2)]))
    rows += [(200 + i, cases.changed(rng, rows[i + 1][1], 0.001), "c") for i in range(30)]
    return [*rows, (300, None, "a"), (301, "", "a")]


def staged(spark, rows):
    """The rows that brute force leaves before encoding."""
    verdicts = {r.doc_id: r.failed for r in quality_rules.verdicts(cases.table(spark, rows)).collect()}
    for d, t, _ in rows:  # the base rules, and no rule but those of the table
        m = cases.metrics(t)
        assert not (m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]) or verdicts[d]
    rows = [r for r in rows if verdicts[r[0]] == ""]
    gone = cases.line_removals([r[:2] for r in rows], 50)
    rows = [(d, "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[d]), s) for d, t, s in rows]
    rows = [r for r in rows if cases.WORD.search(r[1])]
    group = cases.near_groups([r[:2] for r in rows])
    rows = [r for r in rows if group[r[0]] == r[0]]
    copies = dict(cases.mix_copies(rows))
    return [r for r in rows for _ in range(copies[r[0]])]


def test_brute_force(spark, tmp_path):
    rows = fixture(cases.seeded(9))
    cases.table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    with open(public_tokenizers.path(corpus_pipeline.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter((d, np.array(library.encode_ordinary(t), "<u4").tobytes()) for d, t, _ in staged(spark, rows))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in out) == expected
    assert all(r.n_tokens * 4 == len(r.ids) for r in out) and len({d for d, _ in expected}) > 60


def test_stages(spark):
    """All stages but the last keep the columns of documents, of odd rows and of none."""
    for df in (cases.odd(spark), cases.odd(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, "").columns == df.columns, name
            stage(spark, df, "").count()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_near_stage_at_its_own_threshold(spark):
    """Against all pairs at 0.80, with pairs at 16 of 20 shingles, in the band up to 0.85 and below it."""
    rng = cases.seeded(10)
    docs = []
    for i in range(60):
        text = cases.prose(rng, 150, 10**6)
        docs += [(2 * i, text), (2 * i + 1, cases.changed(rng, text, rng.choice([0.01, 0.02, 0.03, 0.05])))]
    words = [f"a{i}" for i in range(22)]
    docs += [(200, " ".join(words)), (201, " ".join([*words[:20], "y1", "y2"]))]
    kept = [{d for d, top in cases.near_groups(docs, percent).items() if d == top} for percent in (80, 85)]
    assert kept[0] < kept[1] and 201 in kept[1] - kept[0] and len(kept[1] - kept[0]) > 3
    assert {r.doc_id for r in corpus_pipeline.dedup_near(spark, cases.table(spark, docs), "").collect()} == kept[0]
