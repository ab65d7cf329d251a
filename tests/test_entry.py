import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry


def test_every_check_has_a_query_and_entry_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("hidden", ["ahocorasick", "public_tokenizers", "tidemark.llm", "corpus_pipeline"])
def test_queries_load_whatever_the_text_operators_lack(hidden):
    code = (
        f"import sys; sys.modules[{hidden!r}] = None\n"
        "import __spark_entry__ as entry\n"
        "assert len(entry.queries()) > 60 and set(entry.oracle_sql()) <= set(entry.queries())\n"
        "assert not any(q.startswith('op') and q[2].isdigit() for q in entry.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True)
