"""Canonical Huffman codes of limited length, packed and unpacked with numpy."""

from __future__ import annotations

import numpy as np

# Longest code. A table of 2 ** 16 entries decodes any of them in one step.
MAX_BITS = 16

# A decoder can start at every so many symbols of a document.
CHECKPOINT = 512


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for the symbols that occur, by package-merge; 0 for the others."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError("too many symbols for this code length")
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    # Each round pairs the cheapest packages of the round before and merges the pairs with the leaves.
    weights, merged = leaves, [np.zeros(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        ranks = np.argsort(both, kind="stable")
        weights = both[ranks]
        merged.append(ranks >= len(leaves))
    # Walk back: of the cheapest 2n - 2 items, every leaf gets one bit more, every package opens two of the round before.
    take = 2 * len(leaves) - 2
    for is_pair in reversed(merged):
        pairs = int(is_pair[:take].sum())
        lengths[order[: take - pairs]] += 1
        take = 2 * pairs
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol: codes of one length are consecutive numbers in symbol order, shorter ones come first."""
    codes = np.zeros(len(lengths), np.uint64)
    code = 0
    for bits in range(1, MAX_BITS + 1):
        symbols = np.flatnonzero(lengths == bits)
        codes[symbols] = code + np.arange(len(symbols))
        code = (code + len(symbols)) << 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for every pattern of the next ``MAX_BITS`` bits."""
    symbols, sizes = np.zeros(1 << MAX_BITS, np.uint16), np.zeros(1 << MAX_BITS, np.uint8)
    codes = canonical_codes(lengths)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = (1 << (MAX_BITS - lengths[order].astype(np.int64)))
    filled = int(spans.sum())
    symbols[:filled] = np.repeat(order, spans)
    sizes[:filled] = np.repeat(lengths[order], spans)
    assert not len(order) or int(codes[order[0]]) == 0
    return symbols, sizes


def pack(symbols: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of the symbols, filled up to a byte, and the bit at which every ``CHECKPOINT``-th symbol starts."""
    if not len(symbols):
        return b"", np.zeros(0, np.int64)
    bits = lengths[symbols].astype(np.int64)
    ends = np.cumsum(bits)
    starts = ends - bits
    words = np.zeros(int(ends[-1]) // 32 + 2, np.uint64)
    # A code lies in at most two words of 32 bits; no two codes share a bit, so sums join them.
    shifted = codes[symbols] << (64 - (starts & 31) - bits).astype(np.uint64)
    word = starts >> 5
    first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
    words[word[first]] += np.add.reduceat(shifted >> np.uint64(32), first)
    words[word[first] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
    packed = words.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8]
    return packed, starts[::CHECKPOINT]


def unpack(data: bytes, bit_starts: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The symbols of all runs: run i has ``counts[i]`` symbols from bit ``bit_starts[i]``. All runs advance together."""
    symbols, sizes = table
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    window = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    order = np.argsort(-counts, kind="stable")
    left = counts[order]
    at = bit_starts[order].astype(np.int64)
    out_at = (np.cumsum(counts) - counts)[order]
    out = np.empty(int(counts.sum()), symbols.dtype)
    steps = int(left[0]) if len(left) else 0
    active = np.searchsorted(-left, -np.arange(1, steps + 1), side="right")
    for step in range(steps):
        n = active[step]
        bit = at[:n]
        peek = (window[bit >> 3] >> (8 - (bit & 7)).astype(np.uint32)) & 0xFFFF
        out[out_at[:n] + step] = symbols[peek]
        at[:n] = bit + sizes[peek]
    return out
