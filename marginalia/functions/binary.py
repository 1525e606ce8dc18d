"""Numbers and strings in byte columns. ``b`` names a byte column or lambda variable in SQL; places count from 1."""

from __future__ import annotations


def uint(b: str, at: str, n: int) -> str:
    """SQL of the big-endian unsigned number in n bytes (up to 7)."""
    return f"cast(conv(hex(substring({b}, {at}, {n})), 16, 10) as bigint)"


def uint_le(b: str, at: str, n: int) -> str:
    """SQL of the little-endian unsigned number in n bytes (up to 7)."""
    swapped = ", ".join(f"substring({b}, {at} + {k}, 1)" for k in reversed(range(n)))
    return f"cast(conv(hex(concat({swapped})), 16, 10) as bigint)"


def bound(value: str, name: str, body: str) -> str:
    """SQL of ``body`` in which ``name`` stands for ``value``, evaluated (and copied from the row) once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def epoch_ms(b: str) -> str:
    """SQL of the local time text of 8 bytes of milliseconds; null for 0 and for times after 4e12 ms (fixed values)."""
    ms = f"cast(conv(hex({b}), 16, 10) as decimal(20, 0))"
    return f"case when {ms} > 0 and {ms} <= 4000000000000 then date_format(timestamp_millis(cast({ms} as bigint)), 'yyyy-MM-dd HH:mm:ss') end"
