import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_core_queries_without_the_libraries_of_the_text_operators():
    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'live_view' in q and set(o) <= set(q) and not any(x.startswith('op') for x in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_every_core_query_has_an_oracle():
    import __spark_entry__ as e
    from tidelog.plans import registry

    assert set(registry.QUERIES) == set(registry.ORACLES) and set(registry.QUERIES) <= set(e.queries())
