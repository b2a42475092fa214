"""Fieldbus register dumps (device, poll, address, reg) to named measurements."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.functions.columns import py_round


@dataclass(frozen=True)
class Register:
    """Where a field lives in the register block and how its number is stored."""
    field: str
    address: int
    dtype: str
    scale: float = 1.0
    offset: float = 0.0
    minimum: float | None = None
    maximum: float | None = None
    invalid: tuple[float, ...] = ()
    word_order: str = "big"
    byte_order: str = "big"

    @property
    def width(self) -> int:
        return 1 if self.dtype in ("uint16", "int16") else 2


# The example energy-meter map.
ENERGY_METER = (
    Register("voltage_v", 0, "uint16", 0.1, minimum=0, maximum=600, invalid=(65535,)),
    Register("current_a", 1, "uint16", 0.01, minimum=0, maximum=600, invalid=(65535,)),
    Register("power_kw", 2, "int32", 0.001, minimum=-2000, maximum=2000, invalid=(2147483647,)),
    Register("power_factor", 4, "int16", 0.001, minimum=0, maximum=1, invalid=(32767,)),
    Register("energy_kwh", 5, "uint32", 0.001, minimum=0, maximum=4000000, invalid=(4294967295,), word_order="little"),
    Register("reactive_power_kvar", 7, "float32", minimum=-2000, maximum=2000),
)


def _swap(word: Column) -> Column:
    return F.shiftleft(word.bitwiseAND(F.lit(255)), 8).bitwiseOR(F.shiftright(word, 8))


def _float32(bits: Column) -> Column:
    """IEEE-754 single from its 32 bits; null for infinities and NaN."""
    sign = F.when(F.shiftright(bits, 31).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
    exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(255))
    fraction = bits.bitwiseAND(F.lit(0x7FFFFF)).cast("double")
    normal = F.pow(F.lit(2.0), exponent - 127) * (fraction / float(1 << 23) + 1.0)
    return F.when(exponent == 255, F.lit(None)).otherwise(sign * F.when(exponent == 0, fraction * 2.0**-149).otherwise(normal))


def raw_value(spec: Register) -> Column:
    """The stored number from columns ``r<address>`` (long words)."""
    words = [F.col(f"r{spec.address + i}") for i in range(spec.width)]
    if spec.byte_order == "little":
        words = [_swap(w) for w in words]
    if spec.width == 1:
        w = words[0]
        return (F.when(w >= 32768, w - 65536).otherwise(w) if spec.dtype == "int16" else w).cast("double")
    high, low = words if spec.word_order == "big" else words[::-1]
    bits = high * 65536 + low
    if spec.dtype == "float32":
        return _float32(bits)
    return (F.when(bits >= 2**31, bits - 2**32).otherwise(bits) if spec.dtype == "int32" else bits).cast("double")


def decode_registers(regs: DataFrame, specs: tuple[Register, ...] = ENERGY_METER) -> DataFrame:
    """One row per device, poll and field: value or the issue that made it null.

    The block of one poll is folded with conditional maxima (map-side combine), so no
    list of registers is collected.
    """
    addresses = sorted({s.address + i for s in specs for i in range(s.width)})
    wide = regs.groupBy("device", "poll").agg(
        *[F.max(F.when(F.col("address") == a, F.col("reg"))).cast("long").alias(f"r{a}") for a in addresses])
    rows = []
    for s in specs:
        raw = raw_value(s)
        missing = F.array_contains(F.array(*[F.col(f"r{s.address + i}").isNull() for i in range(s.width)]), True)
        value = raw * s.scale + s.offset
        out = F.lit(False)
        if s.minimum is not None:
            out = out | (value < s.minimum)
        if s.maximum is not None:
            out = out | (value > s.maximum)
        issue = (F.when(missing, f"register {s.address} not read")
                 .when(raw.isNull() | raw.isin(*s.invalid) if s.invalid else raw.isNull(), "device reports 'not available'")
                 .when(out, "outside plausible range"))
        rows.append(F.struct(F.lit(s.field).alias("field"), F.when(issue.isNull(), py_round(value, 6)).alias("value"), issue.alias("issue")))
    return wide.select("device", "poll", F.explode(F.array(*rows)).alias("f")).select("device", "poll", "f.*")
