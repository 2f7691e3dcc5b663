import pytest

from matchlab.session import scratch_path


@pytest.fixture
def folder(spark):
    return scratch_path(spark, "test")
