"""Steps of op6_context_mixing give what plain forms of them give, for less time of the processor."""

import time
from collections import Counter

import numpy as np
import pyarrow as pa

from quarry.llm import mixlm, shingles


def least(run, times=5):
    took = []
    for _ in range(times):
        began = time.process_time()
        run()
        took.append(time.process_time() - began)
    return min(took)


def plain_sums(odds, gate, bit, weights):
    out = np.zeros((mixlm.GATES, 22))
    order = np.argsort(gate, kind="stable")
    edge = np.searchsorted(gate[order], np.arange(mixlm.GATES + 1))
    x, y = np.ones((4, len(gate)), dtype=np.float32), bit.take(order)
    for k in range(3):
        odds[k].take(order, out=x[k])
    w = weights.astype(np.float32)
    for g in np.flatnonzero(np.diff(edge)).tolist():
        own, on = x[:, edge[g] : edge[g + 1]], y[edge[g] : edge[g + 1]]
        z = w[g] @ own
        np.negative(z, out=z, where=on)
        np.exp(z.clip(-30, 30, out=z), out=z)
        lost = np.log1p(z).sum(dtype=np.float64)
        z /= np.float32(1) + z
        out[g, :4] = own @ np.where(on, z, -z)
        out[g, 4:20] = ((own * (z * (np.float32(1) - z))) @ own.T).reshape(-1)
        out[g, 20:] = lost, len(on)
    return out


def test_newton_sums_cost_less():
    draw = np.random.default_rng(4)
    n = 600_000
    odds, gate, bit = draw.normal(0, 2, (3, n)).astype(np.float32), draw.integers(0, 20, n).astype(np.int8), draw.random(n) < 0.5
    weights = np.tile(mixlm.PLAIN, (mixlm.GATES, 1))
    assert np.allclose(mixlm.newton_sums(odds, gate, bit, weights), plain_sums(odds, gate, bit, weights), rtol=1e-5, atol=1e-2)
    assert least(lambda: mixlm.newton_sums(odds, gate, bit, weights)) < 0.85 * least(lambda: plain_sums(odds, gate, bit, weights))


def test_words_are_counted_for_less(monkeypatch):
    draw = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in draw.integers(0, 200_000, 300)) for _ in range(4000)] + ["", None, " \t\x0b ", "é\x00 É a  A\x1f\n", "last"]
    frames = pa.table({"text": pa.array(texts, pa.string())}).to_batches(max_chunksize=1000)

    def plain():
        found = Counter()
        for t in texts:
            found.update(mixlm.folded(t).split())
        return found

    def counted():
        return [b for b in mixlm._words(iter(frames))]

    for rows in (mixlm.COUNTED_WORDS, 1000):
        monkeypatch.setattr(mixlm, "COUNTED_WORDS", rows)
        got = Counter()
        for b in counted():
            got.update(dict(zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True)))
        assert got == plain() + Counter({mixlm.END: len(texts)})
    monkeypatch.undo()
    assert least(counted, 3) < 0.85 * least(plain, 3)
    assert not list(mixlm._words(iter([])))


def test_word_hashes_are_sums_over_their_bytes():
    for part in ([b""], [b"", b" "], [b"a", b"", b"  bc\x0bd "], [b" x"], [b"\xc3\xa9 a\x00b", b"zz"]):
        buf, starts, lengths, hashes, counts = shingles.word_spans(part)
        words = [p.split() for p in part]
        flat = [w for own in words for w in own]
        assert counts.tolist() == [len(own) for own in words] and lengths.tolist() == [len(w) for w in flat]
        assert [buf[a : a + n].tobytes() for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)] == flat
        for w, h in zip(flat, hashes.tolist(), strict=True):
            total = sum(int(shingles.BYTE[b]) * int(shingles.powers(len(w))[k]) for k, b in enumerate(w)) + len(w) * 0x9E3779B97F4A7C15
            assert h == int(shingles.mix(np.array([total & shingles.MASK], dtype=np.uint64))[0])
