"""The pipeline from end to end on a small table, against what each document should come to."""

import zlib
from collections import defaultdict

import numpy as np
from conftest_llm import edited, prose

import corpus_pipeline
from marginalia.llm.packing import CAPACITY, encoder, word_bpe

TOKEN = "Zx81kQ9vLm2TfR7dWc5B"


def test_pipeline_from_end_to_end(spark, tmp_path):
    good = {k: prose(100 + k, 150 + 40 * k) for k in range(6)}
    texts = dict(good)
    texts[10] = good[2]  # an exact copy
    texts[11] = edited(prose(102, 150 + 80), 7, 2)  # a near copy
    texts[12] = "too short"
    texts[13] = "\n".join("Home | News | Sport | Contact" for _ in range(40))
    texts[14] = prose(300, 200) + f" The key is {TOKEN} as said."
    texts[15] = prose(301, 200) + "\nAll rights reserved. Read more about it."
    texts[16], texts[17] = None, ""
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = {**good, 14: texts[14].replace(TOKEN, "[secret]"), 15: prose(301, 200)}
    taken = {r.doc_id for r in got}  # the mix leaves out what its sources' targets have no room for
    assert taken <= set(kept) and len(taken) >= len(kept) / 2
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= CAPACITY
    encode, cut = encoder(word_bpe()), 0
    for doc_id in taken:
        text = kept[doc_id]
        ids = next(iter(encode([text]))) + np.zeros(1, "<u4").tobytes()
        want = [
            (p, at // 4, len(ids[at : at + 4 * CAPACITY]) // 4, zlib.crc32(ids[at : at + 4 * CAPACITY]))
            for p, at in enumerate(range(0, len(ids), 4 * CAPACITY))
        ]
        assert len(pieces[doc_id]) <= 3 * len(want), doc_id
        other = [p for p in pieces[doc_id] if p not in want]
        cut += len(other)
        assert sum(p[2] for p in other) < len(ids) // 4, doc_id
    assert cut <= 3  # one document of a source may be taken in part
