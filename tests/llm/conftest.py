import pytest

pytest.importorskip("bibmill.llm")
