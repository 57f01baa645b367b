"""Flat state indices and their digits.

A particle with C coin values on P positions is numbered ``coin * P + pos``
(coin-position order) or ``pos * C + coin`` (position-coin order). n particles are
digits of base C * P, the first particle leading. All arithmetic is on BIGINT, so an
index space that does not fit is refused up front.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COIN_POSITION = "coin_position"
POSITION_COIN = "position_coin"
ORDERS = (COIN_POSITION, POSITION_COIN)

_LIMIT = 2**63


def div(a: Column, b: int) -> Column:
    """Integer quotient of a non-negative BIGINT column."""
    return F.call_function("div", a, F.lit(b))


def check_space(base: int, digits: int) -> int:
    """base ** digits, or OverflowError when BIGINT cannot hold the indices."""
    size = base**digits
    if size >= _LIMIT:
        raise OverflowError(f"{base}^{digits} states do not fit a BIGINT index; use the keyed state")
    return size


def check_order(order: str) -> str:
    if order not in ORDERS:
        raise ValueError(f"invalid representation {order!r}; expected one of {ORDERS}")
    return order


def one_particle_index(coin: Column, pos: Column, coins: int, positions: int, order: str) -> Column:
    if check_order(order) == COIN_POSITION:
        return coin * F.lit(positions) + pos
    return pos * F.lit(coins) + coin


def split_one_particle(k: Column, coins: int, positions: int, order: str) -> tuple[Column, Column]:
    """(coin, pos) of a single particle's index."""
    inner = positions if check_order(order) == COIN_POSITION else coins
    high, low = div(k, inner), F.pmod(k, F.lit(inner))
    return (high, low) if order == COIN_POSITION else (low, high)


def digit(k: Column, base: int, particle: int, particles: int) -> Column:
    """Index of one particle inside the joint index."""
    return F.pmod(div(k, base ** (particles - 1 - particle)), F.lit(base))


def join_digits(digits: list[Column], base: int) -> Column:
    result = digits[0]
    for d in digits[1:]:
        result = result * F.lit(base) + d
    return result
