"""One pass for many patterns: which of them a text may match, told by an Aho-Corasick automaton over their needles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def pattern_bits(text: Column, needles: Sequence[Sequence[str]]) -> Column:
    """A number with bit k set if the text holds one of the k-th pattern's needles (lower case), in any case; the long s and
    the Kelvin sign are cases of s and k.

    At most 63 patterns; one without needles has its bit always set. Null gives null. The automaton reads a text once,
    however many patterns and needles there are, and stops as soon as every bit is set.
    """
    if len(needles) > 63:
        raise ValueError("at most 63 patterns")
    masks: dict[str, int] = {}
    always, full = 0, (1 << len(needles)) - 1
    for k, some in enumerate(needles):
        always |= 0 if some else 1 << k
        for needle in some:
            masks[needle] = masks.get(needle, 0) | 1 << k

    @F.arrow_udf("long")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = ahocorasick.Automaton()
        for needle, mask in masks.items():
            automaton.add_word(needle, mask)
        automaton.make_automaton()
        for batch in batches:
            found = []
            for low in pc.ascii_lower(batch).to_pylist():
                bits = always
                if low is not None and masks:
                    plain = low if low.isascii() else low.replace("\u017f", "s").replace("\u212a", "k")
                    for _, mask in automaton.iter(plain):
                        bits |= mask
                        if bits == full:
                            break
                found.append(None if low is None else bits)
            yield pa.array(found, pa.int64())

    return scan(text)


def has_bit(bits: Column, k: int) -> Column:
    return bits.bitwiseAND(F.lit(1 << k)) != 0
