import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


FILES = "file_id bigint, target string, rel_path string, suffix string, content binary, n_bytes bigint"


@pytest.fixture(scope="session")
def make_files(spark):
    """files from (target, rel_path, text or bytes or None)"""

    def make(*rows):
        out = []
        for i, (target, path, content) in enumerate(rows, 1):
            raw = content.encode() if isinstance(content, str) else content
            name = path.rsplit("/", 1)[-1]
            suffix = "." + name.rsplit(".", 1)[-1] if "." in name[1:] else ""
            out.append((i, target, path, suffix, raw, None if raw is None else len(raw)))
        return spark.createDataFrame(out, FILES)

    return make
