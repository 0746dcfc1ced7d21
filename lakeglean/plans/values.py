"""Typing of query values by the field they are compared with."""

from __future__ import annotations

import base64
import ipaddress
import re
from datetime import datetime, timezone
from decimal import Decimal

from lakeglean.plans.errors import QueryError
from lakeglean.plans.schema import Field


def _bad(f: Field, v) -> QueryError:
    return QueryError(f"cannot use {v!r} for field {f.name!r} of type {f.type}")


def typed(f: Field, v):
    """The Python value that compares with the field's column."""
    try:
        if f.type in ("i64", "u64"):
            if isinstance(v, bool) or isinstance(v, float) and v != int(v):
                raise ValueError
            n = int(v)
            if f.type == "u64" and not 0 <= n < 2**64 or f.type == "i64" and not -(2**63) <= n < 2**63:
                raise ValueError
            return Decimal(n) if f.type == "u64" else n
        if f.type == "f64":
            if isinstance(v, bool):
                raise ValueError
            return float(v)
        if f.type == "bool":
            if isinstance(v, bool):
                return v
            return {"true": True, "false": False}[v]
        if f.type == "date":
            return date_value(v)
        if f.type == "ip_addr":
            return canonical_ip(v)
        if f.type == "bytes":
            return base64.b64decode(v, validate=True)
    except (ValueError, KeyError, TypeError, AttributeError):
        raise _bad(f, v) from None
    if isinstance(v, (dict, list)) or v is None:
        raise _bad(f, v)
    return v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


def date_value(v) -> datetime:
    """RFC 3339 text or epoch milliseconds, as UTC."""
    if isinstance(v, bool):
        raise ValueError
    if isinstance(v, (int, float)):
        return datetime.fromtimestamp(v / 1000, timezone.utc)
    if not re.match(r"\d{4}-\d\d-\d\d", v):
        raise ValueError
    d = datetime.fromisoformat(v.replace("Z", "+00:00"))
    return d if d.tzinfo else d.replace(tzinfo=timezone.utc)


def canonical_ip(v: str) -> str:
    """IPv6 text with all digits, IPv4 mapped into it, so that text order is address order."""
    ip = ipaddress.ip_address(v)
    return (ipaddress.IPv6Address(f"::ffff:{ip}") if ip.version == 4 else ip).exploded


def json_type(v) -> str:
    if isinstance(v, bool):
        return "b"
    if isinstance(v, (int, float)):
        return "n"
    if isinstance(v, str):
        return "s"
    raise QueryError(f"cannot use {v!r} for a JSON path")
