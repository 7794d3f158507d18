"""Connected components, as the operators of the register have them."""

from rollbook.operators.components import components  # noqa: F401
