"""Every registered query and its SQL twin."""

from __future__ import annotations

from pathloom.plans import data_layer, extra_layer, inference_layer, model_layer, path_layer

QUERIES: dict = {**data_layer.Q, **path_layer.Q, **inference_layer.Q, **model_layer.Q, **extra_layer.Q}
ORACLES: dict[str, str] = {**data_layer.O, **path_layer.O, **inference_layer.O, **model_layer.O, **extra_layer.O}
FLAGSHIP = "d_base_metrics"
