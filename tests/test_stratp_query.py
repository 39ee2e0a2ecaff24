"""The registered query permutes as often as the operator's default."""

from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


def test_p_values_are_ten_thousandths(spark):
    import __spark_entry__ as e

    p = [r.pval * 10_000 for r in e.queries()["stratp"](spark, SF).collect()]
    assert p and all(abs(x - round(x)) < 1e-6 for x in p)
    assert any(round(x) % 10 for x in p)
