"""Token scores of Arrow batches with numpy: the measured alternative to the built-in array functions.

All rows of a batch are handled at once on the flat values of the list columns; vectors may differ in length
from row to row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


class Segments:
    """Flat values of a list column with per-row sums and maxima."""

    def __init__(self, column: pa.ListArray):
        self.values = column.flatten().to_numpy(zero_copy_only=False)
        self.lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        if column.null_count or (len(self.lengths) and self.lengths.min() < 1):
            raise ValueError("score vectors must not be null or empty")
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1])).astype(np.int64)
        self.rows = np.repeat(np.arange(len(self.lengths)), self.lengths)

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.starts)

    def log_softmax(self, temperature: float) -> np.ndarray:
        shifted = (self.values - np.maximum.reduceat(self.values, self.starts)[self.rows]) / temperature
        return shifted - np.log(self.sums(np.exp(shifted)))[self.rows]

    def pick(self, x: np.ndarray, index: np.ndarray) -> np.ndarray:
        index = np.maximum(index, 0)
        if (index >= self.lengths).any():
            raise ValueError("token id outside its score vector")
        return x[self.starts + index]


def score_batches(
    carried: list[str], temperature: float, clip: float | None, clip_mode: str, beta: float | None = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function for ``mapInArrow``: carried columns followed by the ten scores, and the mixture divergence for a ``beta`` in (0, 1)."""

    def capped(terms: np.ndarray, rows: Segments) -> np.ndarray:
        if clip is None:
            return rows.sums(terms)
        return rows.sums(np.minimum(terms, clip)) if clip_mode == "element" else np.minimum(rows.sums(terms), clip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            student, teacher = Segments(batch.column("student")), Segments(batch.column("teacher"))
            if not np.array_equal(student.lengths, teacher.lengths):
                raise ValueError("student and teacher score different vocabularies")
            ls, lt = student.log_softmax(temperature), teacher.log_softmax(temperature)
            ps, pt = np.exp(ls), np.exp(lt)
            forward, reverse = pt * (lt - ls), ps * (ls - lt)
            label, token = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "token_id"))
            scores = [
                -student.sums(ps * ls),
                -student.sums(ps * np.log(ps + 1e-10)),
                -student.sums(pt * lt),
                student.sums(forward),
                student.sums(reverse),
                capped(forward, student),
                capped(reverse, student),
                student.pick(ls, label),
                student.pick(ls, token),
                student.pick(lt, token),
            ]
            names = carried + SCORES
            if beta is not None:
                mixed = np.logaddexp(ls + np.log1p(-beta), lt + np.log(beta))
                scores.append(capped(beta * pt * (lt - mixed) + (1 - beta) * ps * (ls - mixed), student))
                names = names + ["jsd_clipped"]
            columns = [batch.column(c) for c in carried] + [pa.array(s) for s in scores]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def top_k_batches(k: int, columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function for ``mapInArrow``: ``student`` and ``teacher`` cut to the teacher's ``k`` highest entries, the first of equal ones, in their order.

    A partial selection per row instead of a sort of the vocabulary; rows of equal length are handled at once.
    """

    def chosen(scores: np.ndarray) -> np.ndarray:
        """Of rows of one length, which entries stay."""
        width = scores.shape[1]
        if width <= k:
            return np.ones(scores.shape, dtype=bool)
        least = np.partition(scores, width - k, axis=1)[:, width - k, None]
        above, at = scores > least, scores == least
        return above | (at & (np.cumsum(at, axis=1) <= k - above.sum(axis=1)[:, None]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            student, teacher = Segments(batch.column("student")), Segments(batch.column("teacher"))
            if not np.array_equal(student.lengths, teacher.lengths):
                raise ValueError("student and teacher score different vocabularies")
            keep = np.zeros(len(teacher.values), dtype=bool)
            for width in np.unique(teacher.lengths):
                at = (teacher.starts[teacher.lengths == width, None] + np.arange(width)).reshape(-1)
                keep[at] = chosen(teacher.values[at].reshape(-1, width)).reshape(-1)
            ends = np.concatenate([[0], np.cumsum(teacher.sums(keep.astype(np.int64)))])
            cut = {n: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(s.values[keep])) for n, s in (("student", student), ("teacher", teacher))}
            yield pa.RecordBatch.from_arrays([cut.get(c, batch.column(c)) for c in columns], names=columns)

    return run


SCORES = [
    "student_entropy", "student_entropy_eps", "teacher_entropy", "fkl", "rkl", "fkl_clipped", "rkl_clipped", "logp",
    "student_logp", "teacher_logp",
]
