"""Universal hashing as column arithmetic, with seeded coefficients fixed when the plan is built."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every 64-bit number."""
    small = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
    if n < 2 or any(n % p == 0 for p in small):
        return n in small
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in small:
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def prime_after(n: int) -> int:
    """The least prime greater than n."""
    n += 1
    while not is_prime(n):
        n += 1
    return n


@dataclass(frozen=True)
class Hash:
    """h(x) = ((a x + b) mod p) mod m; a, b and p stay under 2**31, so that products stay in a long."""

    a: int
    b: int
    p: int
    m: int

    def of(self, x: Column) -> Column:
        """The hash of a long column (x is first taken modulo p, which changes nothing)."""
        return F.pmod(F.pmod(F.pmod(x, F.lit(self.p)) * self.a + self.b, F.lit(self.p)), F.lit(self.m))

    def sql(self, x: str) -> str:
        return f"((({x}) % {self.p} * {self.a} + {self.b}) % {self.p}) % {self.m}"


def family(k: int, m: int, seed: int, spread: int = 10_000_000) -> list[Hash]:
    """k hash functions into range m, the same for the same seed."""
    rng = random.Random(seed)
    return [Hash(rng.randint(1, m), rng.randint(1, m), prime_after(rng.randint(m, m + spread)), m) for _ in range(k)]


def text_mod(text: Column, p: int) -> Column:
    """The bytes of a text as one big-endian integer, modulo p: folded byte by byte, so it never overflows."""
    digits = F.hex(text.cast("binary"))
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    fold = F.aggregate(codes, F.lit(0).cast("long"), lambda r, c: F.pmod(r * 256 + c, F.lit(p)))
    return F.when(F.length(text) > 0, fold).otherwise(F.when(text.isNotNull(), F.lit(0).cast("long")))


def trailing_zeros(x: Column) -> Column:
    """Zeros at the end of a non-negative integer in binary; 0 is the one digit 0 and counts 1."""
    return F.when(x == 0, 1).otherwise(F.bit_count(x.bitwiseAND(-x) - 1))


def key_long(text: Column) -> Column:
    """A text as a long of 60 bits of its md5; the same in any engine."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
