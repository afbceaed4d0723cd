"""Contract checks raise one kind of error."""

from __future__ import annotations


class ContractError(ValueError):
    """Data or configuration that breaks a documented contract."""


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ContractError(message)
