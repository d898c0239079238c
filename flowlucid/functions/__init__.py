from .columns import (
    derived_features, encode_binary, hash_key, joint_label, label_text, nan_to_null,
    safe_div, tactic_of, week_start, with_flow_features, with_joint_label,
)

__all__ = [
    "derived_features", "encode_binary", "hash_key", "joint_label", "label_text", "nan_to_null",
    "safe_div", "tactic_of", "week_start", "with_flow_features", "with_joint_label",
]
