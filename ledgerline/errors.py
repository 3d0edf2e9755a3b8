"""Stable failure codes and the categories they belong to."""

from __future__ import annotations

# Public failure codes and categories.
CONTRACT = "pil.input.semantic_contract_violation"
TYPE = "pil.input.semantic_type_contract_violation"
SCOPE = "pil.input.scope_contract_violation"
SCOPE_MISMATCH = "pil.policy.scope_mismatch"
TEMPORAL = "pil.input.temporal_contract_violation"
POLICY = "pil.policy.contract_violation"
NO_GOVERNING_SOURCE = "pil.policy.reconciliation_no_governing_source"
AUTHORITY = "pil.authorization.authority_contract_violation"
AUTHORITY_SCOPE = "pil.authorization.scope_mismatch"
REQUEST_SCOPE = "pil.authorization.request_scope_denied"
IDEMPOTENCY = "pil.policy.idempotency_contract_violation"


def category_of(code: str) -> str:
    return code.split(".")[1]


class ContractError(ValueError):
    """A driver-side argument breaks a contract."""

    def __init__(self, message: str, code: str = CONTRACT) -> None:
        super().__init__(message)
        self.code = code
        self.category = category_of(code)

    def as_dict(self) -> dict[str, str]:
        return {"code": self.code, "category": self.category, "message": str(self)}


class AccessDenied(PermissionError):
    """The caller lacks a permission or asks for another scope."""

    code = REQUEST_SCOPE
    category = "authorization"

    def as_dict(self) -> dict[str, str]:
        return {"code": self.code, "category": self.category, "message": str(self)}
