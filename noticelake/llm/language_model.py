"""Features and linear machines of language identification, for use inside tasks: numpy and Arrow, nothing of Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from noticelake.llm.worker import lean

DIM = 2048
UNKNOWN = "und"

_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _LETTER[ord("a")]:
        _LETTER[:] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def features(text: str) -> np.ndarray | None:
    """Square roots of hashed pair and triple counts, of length one; None without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]  # one space for many
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    pairs = (codes[:-1] * np.uint32(0x9E3779B1)) ^ (codes[1:] * np.uint32(0x85EBCA77))
    triples = (pairs[:-1] * np.uint32(0xC2B2AE3D)) ^ (codes[2:] * np.uint32(0x27D4EB2F))
    hashed = np.concatenate([pairs, triples])
    hashed ^= hashed >> np.uint32(15)
    counts = np.sqrt(np.bincount((hashed * np.uint32(0x2C1B3C6D)) >> np.uint32(21), minlength=DIM).astype(np.float32))
    return counts / np.linalg.norm(counts)


def support_vector_machine(x: np.ndarray, yes: np.ndarray, penalty: float = 1e-4, steps: int = 30) -> tuple[np.ndarray, float]:
    """(weights, intercept) of the linear machine with squared hinge loss, both classes weighing the same.

    Newton's method: in each step the rows within the margin make a least-squares problem,
    which conjugate gradients solve; a step is halved until the loss falls.
    """
    n = len(x)
    sign = np.where(yes, 1.0, -1.0)
    weight = np.where(yes, 0.5 / max(1, yes.sum()), 0.5 / max(1, n - yes.sum()))
    rows = np.concatenate([x, np.ones((n, 1), x.dtype)], 1)
    ridge = np.append(np.full(x.shape[1], penalty), penalty * 1e-3)
    w = np.zeros(rows.shape[1])

    def loss(w: np.ndarray) -> float:
        return float(weight @ np.maximum(0, 1 - sign * (rows @ w)) ** 2 + ridge @ (w * w))

    now = loss(w)
    for _ in range(steps):
        slack = np.maximum(0, 1 - sign * (rows @ w))
        gradient = 2 * (ridge * w - rows.T @ (weight * sign * slack))
        inside = weight * (slack > 0)
        turn, rest = np.zeros_like(w), -gradient
        along, size = rest.copy(), float(rest @ rest)
        if size < 1e-16:
            break
        for _ in range(60):
            bent = 2 * (ridge * along + rows.T @ (inside * (rows @ along)))
            far = size / float(along @ bent)
            turn += far * along
            rest -= far * bent
            size, before = float(rest @ rest), size
            if size < 1e-4 * float(gradient @ gradient):
                break
            along = rest + size / before * along
        step = 1.0
        while step > 1e-4 and loss(w + step * turn) >= now:
            step /= 2
        if step <= 1e-4:
            break
        w += step * turn
        now, before = loss(w), now
        if before - now < 1e-6 * before:
            break
    return w[:-1].astype(np.float32), float(w[-1])


class Vote:
    """Machines between all pairs of some names."""

    def __init__(self, names: list[str], machines: list[tuple[str, str, np.ndarray, float]]):
        self.names = sorted(names)
        place = {n: i for i, n in enumerate(self.names)}
        self.pairs = [(place[a], place[b]) for a, b, _, _ in machines]
        self.weights = np.stack([w for _, _, w, _ in machines], 1) if machines else None
        self.intercepts = np.array([b for _, _, _, b in machines])

    def choose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the index of the name with the most votes, and its chance: the least of those that its machines give it. Among equals the greater chance, then the later name."""
        won, chance = np.zeros((len(x), len(self.names))), np.ones((len(x), len(self.names)))
        if self.pairs:
            p = 1 / (1 + np.exp(-np.clip(2 * (x @ self.weights + self.intercepts), -30, 30)))
            for k, (a, b) in enumerate(self.pairs):
                won[:, a] += p[:, k] >= 0.5
                won[:, b] += p[:, k] < 0.5
                chance[:, a], chance[:, b] = np.minimum(chance[:, a], p[:, k]), np.minimum(chance[:, b], 1 - p[:, k])
        rank = won + chance * 0.999
        best = rank.shape[1] - 1 - rank[:, ::-1].argmax(1)
        return best, chance[np.arange(len(x)), best]


class LanguageModel:
    """``languages`` by family, a vote between families, and one within each family."""

    def __init__(self, languages: dict[str, list[str]], families: list, within: dict[str, list]):
        self.families = Vote(list(languages), families)
        self.within = [Vote(languages[f], within[f]) for f in self.families.names]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score from 0 to 1) of each text."""
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not self.families.names:
            return out
        found = [(i, x) for i, x in ((i, features(t)) for i, t in enumerate(texts) if t) if x is not None]
        if not found:
            return out
        rows = np.stack([x for _, x in found])
        family, p = self.families.choose(rows)
        for f, vote in enumerate(self.within):
            at = np.flatnonzero(family == f)
            lang, q = vote.choose(rows[at])
            for k, name, score in zip(at.tolist(), lang.tolist(), (p[at] * q).tolist(), strict=True):
                out[found[k][0]] = (vote.names[name], score)
        return out


def scorer(model: object, width: int = 64):
    """A function from iterators of Arrow arrays of texts to those of (lang_pred, score), ``width`` texts at a time."""

    @lean
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            langs, scores = [], []
            for at in range(0, len(batch), width):
                found = model.value.predict(batch.slice(at, width).to_pylist())
                langs += [lang for lang, _ in found]
                scores += [s for _, s in found]
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return score


@lean
def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (lang, pick, text) as (lang, pick, x); texts without letters are left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            found = [(lang, pick, x.tobytes()) for lang, pick, x in zip(part.column("lang").to_pylist(), part.column("pick").to_pylist(), map(features, part.column("text").to_pylist()), strict=True) if x is not None]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else ([], [], []), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["lang", "pick", "x"])


def fitted(group: pa.Table) -> pa.Table:
    """An Arrow table of the rows (level, first, second, yes, x) of one pair as its machine; rows in the order of their pick."""
    group = group.sort_by([("pick", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(group.column("x").to_pylist()), np.float32).reshape(-1, DIM)
    weights, intercept = support_vector_machine(x, group.column("yes").to_numpy().astype(bool))
    return pa.table({"level": group.column("level")[:1], "first": group.column("first")[:1], "second": group.column("second")[:1], "weights": pa.array([weights.tobytes()], pa.binary()), "intercept": pa.array([intercept], pa.float64())})
