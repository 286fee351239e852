import subprocess
import sys
from pathlib import Path

from metricloom.session import pin

ROOT = Path(__file__).parent.parent

NAMED = """
import sys
from metricloom.session import build_session, pin
spark = build_session("named", master="local[2]", spark__ui__enabled="false", spark__checkpoint__dir=sys.argv[1])
print("ROWS", pin(spark.range(5)).count(), spark.sparkContext.getCheckpointDir())
"""


def test_pinned_rows_have_no_lineage(spark):
    df = pin(spark.range(10).where("id % 2 = 0"))
    assert df.count() == 5
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and "Filter" not in plan


def test_the_named_folder_is_used(tmp_path):
    done = subprocess.run(
        [sys.executable, "-c", NAMED, str(tmp_path)], cwd=ROOT, capture_output=True, text=True, timeout=120
    )
    line = next(x for x in done.stdout.splitlines() if x.startswith("ROWS"))
    assert line.startswith("ROWS 5") and str(tmp_path) in line
    assert any(tmp_path.rglob("*"))
