"""Numbers, arrays and frame counts."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def digit_orders(n: Column, orders: int = 15) -> Column:
    """Digits from the ones upwards."""
    return F.transform(F.sequence(F.lit(0), F.lit(orders - 1)), lambda i: F.pmod(F.floor(n / F.pow(F.lit(10.0), i)), F.lit(10)).cast("int"))


def frame_count(samples: Column, rate: Column) -> Column:
    """Frames of 20 ms whose windows fit; -1 for no samples."""
    ms = F.floor(samples / rate * 1000)
    return F.floor((ms - F.pmod(ms, F.lit(5)) - 1) / 20)


def frame_count_stft(samples: Column, n_fft: Column) -> Column:
    """Frames of a centred transform with half-window hop."""
    return F.floor(samples * 2 / n_fft) + 1


def edit_similarity(a: Column, b: Column) -> Column:
    """Length of the longer less the edit distance."""
    return F.greatest(F.length(a), F.length(b)) - F.levenshtein(a, b)


def learning_rate(epoch: Column, epochs: float, warm_up: float) -> Column:
    """Linear rise over the warm-up share, then linear fall to 0."""
    w = epochs * warm_up
    return F.when(epoch < w, epoch / w).otherwise((F.lit(epochs) - epoch) / (epochs - w))


def clock_12h(hour: Column, ahead: int = 0) -> Column:
    """The hour on a 12-hour dial, 12 for 0."""
    h = F.pmod(hour + ahead, F.lit(12))
    return F.when(h == 0, 12).otherwise(h)


def pad_right(array: Column, length: Column, value: Column) -> Column:
    """The array with ``value`` up to ``length``."""
    return F.concat(array, F.array_repeat(value, F.greatest(length - F.size(array), F.lit(0)).cast("int")))


def pad_batch(array: Column, batch: Column, value: Column) -> Column:
    """Arrays padded to the longest of their batch."""
    return pad_right(array, F.max(F.size(array)).over(Window.partitionBy(batch)), value)


def reflect_pad(array: Column, n: int) -> Column:
    """The array with ``n`` mirrored values on both sides, the edge not repeated."""
    size = F.size(array)
    return F.concat(F.reverse(F.slice(array, 2, n)), array, F.reverse(F.slice(array, size - n, F.lit(n))))


def to_mono(channels: Column) -> Column:
    """Mean over the channels, sample by sample."""
    total = F.aggregate(F.slice(channels, 2, 1 << 20), F.transform(channels[0], lambda v: v.cast("double")), lambda a, c: F.zip_with(a, c, lambda x, y: x + y))
    return F.transform(total, lambda v: v / F.size(channels))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, temperature: float = 1.0) -> Column:
    return dot(a, b) / (norm(a) * norm(b)) / temperature


def argmax(a: Column) -> Column:
    """0-based position of the first largest value."""
    return F.array_position(a, F.array_max(a)) - 1


def cross_entropy(logits: Column, target: Column) -> Column:
    """-log softmax[target], shifted by the largest logit."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, v: s + F.exp(v - top))
    return F.log(total) + top - F.get(logits, target)


def span_mask(length: Column, starts: Column, span: int) -> Column:
    """Sorted distinct positions covered by spans from the starts, inside the length."""
    spread = F.flatten(F.transform(starts, lambda s: F.sequence(s, s + span - 1)))
    return F.array_sort(F.array_distinct(F.filter(spread, lambda p: p < length)))


def random_starts(length: Column, key: Column, share: float, span: int, seed: int = 0) -> Column:
    """floor(length * share) distinct starts below length - span, by a hash of seed, key and place."""
    places = F.when(length > span, F.sequence(F.lit(0), (length - span - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    ranked = F.array_sort(F.transform(places, lambda p: F.struct(F.xxhash64(F.lit(seed), key, p).alias("h"), p.alias("p"))))
    return F.transform(F.slice(ranked, 1, F.greatest(F.floor(length * share), F.lit(0)).cast("int")), lambda s: s["p"])


def masked(array: Column, positions: Column, value: Column) -> Column:
    """The array with ``value`` at the 0-based positions."""
    return F.transform(array, lambda v, i: F.when(F.array_contains(positions, i), value).otherwise(v))
