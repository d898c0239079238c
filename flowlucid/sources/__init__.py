from .flows import read_flows, register_view, write_weekly_flows
from .store import (
    load_model, load_predictions, save_model, save_predictions, save_report, write_metric_sheet,
)

__all__ = [
    "load_model", "load_predictions", "read_flows", "register_view", "save_model",
    "save_predictions", "save_report", "write_metric_sheet", "write_weekly_flows",
]
