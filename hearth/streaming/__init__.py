"""The stateless scoring operators applied to a streaming source."""

from hearth.streaming.scoring import score_stream, start_metrics, start_scoring  # noqa: F401
