import os
import sys

import pytest

_HERE = os.path.dirname(os.path.abspath(__file__))
_REPO = os.path.dirname(_HERE)
sys.path.insert(0, _REPO)
# Python workers must import the package and test helpers pickled by reference.
os.environ["PYTHONPATH"] = os.pathsep.join([_REPO, _HERE] + [p for p in [os.environ.get("PYTHONPATH")] if p])


@pytest.fixture(scope="session")
def spark():
    from quarry.session import get_session
    s = get_session("local[4]", 8, app_name="quarry-tests")
    yield s
    from quarry.session import drop_lineage_tables
    drop_lineage_tables(s)
    s.stop()


def corpus_df(spark, docs: dict[str, str]):
    """(path, text, size, mtime_ns) corpus from a dict."""
    rows = [(p, t, len(t.encode()), i) for i, (p, t) in enumerate(sorted(docs.items()))]
    return spark.createDataFrame(rows, "path string, text string, size long, mtime_ns long")
