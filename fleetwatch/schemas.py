"""Table schemas. Every table is keyed by ``robot_id`` or ``run_id``; ``seq`` orders rows of equal time."""

from __future__ import annotations

SCAN = "robot_id string, recv_ts timestamp, seq long, stamp_s double, angle_min double, angle_max double, ranges array<float>"
ODOM = "robot_id string, recv_ts timestamp, seq long, x double, y double, qx double, qy double, qz double, qw double, v_lin double, v_ang double"
CMD = "robot_id string, recv_ts timestamp, seq long, publisher string, v_lin double, v_ang double"
IMU = "robot_id string, recv_ts timestamp, seq long, ax double, ay double"
ENVELOPE = "robot_id string, recv_ts timestamp, seq long, receiver string, topic string, raw string"
NODE_SNAPSHOT = "robot_id string, poll_seq long, poll_ts timestamp, namespace string, name string"
PUBLISHER_SNAPSHOT = "robot_id string, tick_ts timestamp, topic string, node_name string, node_namespace string"
WHITELIST = "name string"
TOPIC_ALLOW = "topic string, node_name string"
WAYPOINT = "route_id string, seq int, name string, x double, y double"
OBSTACLE = "ox double, oy double"
STEP = (
    "run_id string, episode long, step int, x double, y double, yaw double, ranges array<float>, action array<float>, "
    "reward double, terminated boolean, truncated boolean, event string, wp_index int"
)
EPISODE = (
    "run_id string, episode long, seed long, reward double, steps int, spl double, success int, collision int, "
    "timeout int, wp_done int, clearance double"
)
ALERT = "robot_id string, recv_ts timestamp, seq long, source string, text string"
HEALTH = "robot_id string, tick_ts timestamp, report string"
EVAL = ("episode", "seed", "reward", "steps", "spl", "success", "collision", "timeout", "wp_done", "clearance")
