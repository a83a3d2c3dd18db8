from hearth.session import DEFAULT_CONF, checkpoint_dir
from hearth.sources import materialise


def test_checkpoint_dir_reads_the_session_setting(spark):
    d = checkpoint_dir(spark)
    assert d == spark.sparkContext.getCheckpointDir()
    out = materialise(spark.range(5), "session-test")
    assert out.count() == 5
    assert any("session-test" in f for f in out.inputFiles())
    assert all(f.split(":", 1)[-1].lstrip("/").startswith(d.split(":", 1)[-1].lstrip("/"))
               for f in out.inputFiles())


def test_defaults_keep_the_ui_off_and_aqe_on():
    assert DEFAULT_CONF["spark.ui.enabled"] == "false"
    assert DEFAULT_CONF["spark.sql.adaptive.enabled"] == "true"
    assert DEFAULT_CONF["spark.sql.adaptive.skewJoin.enabled"] == "true"
