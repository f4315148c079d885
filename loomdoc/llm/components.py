"""Connected components; they are in operators, which do not import llm."""

from loomdoc.operators.components import components  # noqa: F401
