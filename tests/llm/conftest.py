import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside, given as columns of the input.
CLASHING = ("row", "run", "best", "shard", "slot", "kept", "ids", "spans", "fingerprint", "component", "text_hash", "one", "two", "_id", "_hash", "largest")


@pytest.fixture
def docs(spark):
    """Documents from (id, text) pairs, with extra columns whose names clash with those inside the operators."""

    def make(*rows, lang="en"):
        df = spark.createDataFrame([(i, t, lang, "src0", None) for i, t in rows], SCHEMA)
        return df.withColumns({c: F.lit("x") for c in CLASHING})

    return make


PROSE = (
    "the river runs past the old mill and under the stone bridge where children fish on summer evenings while boats drift by "
    "slowly and the miller counts his sacks of flour before the long walk home through fields of barley and tall grass at dusk "
    "with his dog beside him and a lantern in his hand to light the narrow path"
)
