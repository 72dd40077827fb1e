"""128-bit addresses as two 64-bit columns: high is the key; low has the tenant, the flag and the salt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of the tenant, of the flag that says that the key is a type's hash, and of the salt.
TENANT_BITS, FLAG_BITS, SALT_BITS = 48, 1, 15


def packed(key: Column, tenant: Column, flag: Column, salt: Column) -> Column:
    """struct(high, low)."""
    low = F.shiftleft(tenant.cast("long"), FLAG_BITS + SALT_BITS).bitwiseOR(F.shiftleft(flag.cast("long"), SALT_BITS)).bitwiseOR(salt.cast("long").bitwiseAND(F.lit((1 << SALT_BITS) - 1)))
    return F.struct(key.cast("long").alias("high"), low.alias("low"))


def fields(high: Column, low: Column) -> dict[str, Column]:
    """key, tenant, flag, salt, and what the key is: created_at, or struct_hash where the flag is set."""
    flag = F.shiftright(low, SALT_BITS).bitwiseAND(F.lit(1)) == 1
    return {
        "key": high, "tenant": F.shiftrightunsigned(low, FLAG_BITS + SALT_BITS), "flag": flag, "salt": low.bitwiseAND(F.lit((1 << SALT_BITS) - 1)),
        "created_at": F.when(~flag, high), "struct_hash": F.when(flag, high),
    }
