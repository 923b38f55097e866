"""Functions of token and sample arrays, all built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The codec's frame and vocabulary.
HOP, FRAME_RATE, VOCABULARY, SAMPLE_RATE, DECODE_RATE = 320, 50, 65_536, 16_000, 24_000
IGNORED = -100


def expected_frames(n_samples: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n_samples / HOP)).cast("long")


def duration_bucket(duration: Column, edges=(2.0, 4.0, 6.0, 8.0, 10.0)) -> Column:
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= duration)).cast("long")


def unique_ratio(codes: Column) -> Column:
    return F.when(F.size(codes) > 0, F.size(F.array_distinct(codes)) / F.size(codes)).otherwise(0.0)


def assemble(head: Column, codes: Column, base: int, start: int, end: int) -> Column:
    """Prompt, start mark, shifted codes, end mark."""
    return F.concat(head, F.array(F.lit(start)), F.transform(codes, lambda c: c + base), F.array(F.lit(end)))


def generated_codes(ids: Column, base: int, end: int, vocabulary: int = VOCABULARY) -> Column:
    """Codes among generated ids: those before the end mark that lie in the codec's range."""
    at = F.array_position(ids, end)
    cut = F.when(at > 0, F.slice(ids, F.lit(1), (at - 1).cast("int"))).otherwise(ids)
    return F.transform(F.filter(cut, lambda t: (t >= base) & (t < base + vocabulary)), lambda t: t - base)


def padded_to(values: Column, length: Column, pad) -> Column:
    return F.concat(values, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), length - F.size(values)).cast("int")))


def pad_to_hop(samples: Column, hop: int = HOP) -> Column:
    return padded_to(samples, F.size(samples) + F.pmod(-F.size(samples), F.lit(hop)), 0.0)


def fsq_digits(token: Column, levels: list[int]) -> Column:
    """Mixed-radix digits of a token, the first level varying fastest. The levels are a parameter."""
    out, basis = [], 1
    for level in levels:
        out.append(F.pmod(F.floor(token / basis).cast("long"), F.lit(level)).cast("int"))
        basis *= level
    return F.array(*out)


def peak_normalised(samples: Column) -> Column:
    peak = F.array_max(F.transform(samples, F.abs))
    return F.when(peak > 1, F.transform(samples, lambda x: x / peak)).otherwise(samples)


def int16_roundtrip(samples: Column) -> Column:
    """Stored as int16 (scale 32767, truncated) and read back (scale 32768)."""
    return F.transform(samples, lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * 32767).cast("int") / F.lit(32768.0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def si_sdr(reference: Column, estimate: Column, cap: float = 100.0, *, strict: bool = False) -> Column:
    """Scale-invariant signal-to-distortion ratio in dB over the common length; null, or an error if strict, if the reference is silent."""
    silent = F.raise_error(F.lit("the reference is silent")).cast("double") if strict else F.lit(None).cast("double")
    n = F.least(F.size(reference), F.size(estimate))
    centred = lambda a: let(F.transform(F.slice(a, F.lit(1), n), lambda x: x.cast("double")), lambda v: let(total(v) / F.size(v), lambda m: F.transform(v, lambda x: x - m)))
    dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))

    def value(r: Column, e: Column) -> Column:
        def of(scale: Column, power: Column) -> Column:
            noise = total(F.zip_with(e, r, lambda a, b: (a - scale * b) * (a - scale * b)))
            return let(noise, lambda q: F.when(power == 0, silent).when(q == 0, F.lit(cap)).otherwise(F.least(10 * F.log10(F.try_divide(scale * scale * power, q)), F.lit(cap))))

        return let(dot(r, r), lambda power: let(F.try_divide(dot(r, e), power), lambda scale: of(scale, power)))

    return let(centred(reference), lambda r: let(centred(estimate), lambda e: value(r, e)))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
