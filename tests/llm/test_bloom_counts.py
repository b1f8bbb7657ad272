"""Word counts beyond 32 bits."""

import numpy as np
import pandas as pd

from panelith.llm import bloom_lm


def test_counts_beyond_32_bits():
    key = np.array([77], np.uint64).tobytes()
    blocks = [(1, 0, key, b"", b"", *bloom_lm._small(np.array([4_000_000_000])))] * 2
    merged = bloom_lm._merge(pd.DataFrame(blocks, columns=["kind", "bucket", "heads", "runs", "tails", "small", "large"]))
    segment = bloom_lm._finish(0)(merged, pd.DataFrame({"head": [77], "given": [5_000_000_000]})).iloc[0]
    shape = [(0, len(segment["filter"]) // 8, len(segment["once"]) // 8, len(segment["words"]) // 8)]
    group = bloom_lm.Group([segment], shape, 0)
    assert segment["tokens"] == 8_000_000_000
    assert [x.tolist() for x in group.exact(np.array([77, 78], np.uint64))] == [[8_000_000_000, 0], [5_000_000_000, 0]]


def test_blocks_of_occupied_buckets_only():
    r = np.random.default_rng(0)
    tokens = r.integers(0, 2**63, 50, dtype=np.int64).astype(np.uint64)
    rows = [*bloom_lm._word_blocks(tokens, 30), *bloom_lm._pair_blocks(bloom_lm.histories(tokens), tokens, 30)]
    assert len(rows) <= 100 and sum(len(x[2]) // 8 for x in rows if x[0] == 1) == len(set(tokens.tolist()))
