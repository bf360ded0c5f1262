import re
from pathlib import Path

import __spark_entry__ as entry

HERE = Path(entry.__file__).parent


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 40
    assert {"p5_found", "p7_found"} <= set(queries)
    if (HERE / "caseweave/llm").exists():
        assert {"p1_found", "p2_found", "p3_found", "p4_found", "p6_found", "p8_ids", "p10_found"} <= set(queries)


def test_nothing_imports_the_subpackage():
    for p in (HERE / "caseweave").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"caseweave\.llm|from \.+llm", p.read_text()), p
