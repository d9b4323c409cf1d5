"""Typed readers, batch or stream, and the small reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas

# The default allow-lists, waypoints and obstacles of one arena.
DEFAULT_WHITELIST = [
    "bt_navigator", "planner_server", "controller_server", "map_server", "amcl", "behavior_server",
    "waypoint_follower", "velocity_smoother", "lifecycle_manager_navigation", "lifecycle_manager_localization",
    "robot_state_publisher", "joint_state_publisher", "rviz2", "rviz", "cartographer_node",
    "cartographer_occupancy_grid_node", "turtlebot3_node", "turtlebot3_fake_node", "diff_drive_controller",
    "teleop_keyboard", "turtlebot3_patrol_server", "my_nav_client", "dds_security_monitor", "patrol_node",
    "ros_gz_bridge", "ros_gz_image", "ros_gz_point_cloud", "ros_gz_sim", "gazebo", "gzserver", "gzclient",
    "route_server", "smoother_server", "collision_monitor", "docking_server", "nav2_container", "nav_to_pose_client",
    "sensor_hub_node", "mission_manager_node", "system_status_node", "intelligent_defense_node", "mission_manager",
    "monitor_node", "burger_env_top",
]
DEFAULT_TOPIC_ALLOW = {
    "/cmd_vel": ["burger_env_top", "teleop_keyboard", "patrol_node", "dds_security_monitor", "intelligent_defense_node"],
    "/scan": ["ros_gz_bridge", "parameter_bridge", "hokuyo_driver", "rplidar_node", "ldlidar_node", "urg_node"],
    "/odom": ["ros_gz_bridge", "parameter_bridge", "turtlebot3_node", "diff_drive_controller", "gazebo"],
    "/imu": ["ros_gz_bridge", "parameter_bridge", "turtlebot3_node", "gazebo"],
}
DEFAULT_WAYPOINTS = [
    ("default", 0, "power control room", -1.5, -1.5),
    ("default", 1, "cooling tower", 1.5, -1.5),
    ("default", 2, "production line A", -1.5, 1.5),
    ("default", 3, "production line B", 1.5, 1.5),
    ("default", 4, "entrance", 0.0, -1.8),
]
DEFAULT_OBSTACLES = [(x, y) for x in (-1.1, 0.0, 1.1) for y in (-1.1, 0.0, 1.1)]


def read(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", stream: bool = False, **options) -> DataFrame:
    """Reads with a declared schema; nothing is inferred. Works for parquet, orc, json and csv."""
    source = spark.readStream if stream else spark.read
    return source.schema(schema).options(**options).format(fmt).load(path)


def read_scans(spark, path, **kw) -> DataFrame:
    return read(spark, path, schemas.SCAN, **kw)


def read_odom(spark, path, **kw) -> DataFrame:
    return read(spark, path, schemas.ODOM, **kw)


def read_cmds(spark, path, **kw) -> DataFrame:
    return read(spark, path, schemas.CMD, **kw)


def read_imu(spark, path, **kw) -> DataFrame:
    return read(spark, path, schemas.IMU, **kw)


def read_envelopes(spark, path, **kw) -> DataFrame:
    """Raw signed text; malformed rows are kept for ``integrity.verify`` to judge."""
    return read(spark, path, schemas.ENVELOPE, **kw)


def read_node_snapshots(spark, path, **kw) -> DataFrame:
    from ..operators.graph import with_node

    return with_node(read(spark, path, schemas.NODE_SNAPSHOT, **kw))


def read_publisher_snapshots(spark, path, **kw) -> DataFrame:
    """A bag: duplicate rows are two publishers of one name."""
    return read(spark, path, schemas.PUBLISHER_SNAPSHOT, **kw)


def read_steps(spark, path, **kw) -> DataFrame:
    return read(spark, path, schemas.STEP, **kw)


def read_episodes(spark, path, fmt="csv", **kw) -> DataFrame:
    """Episode records; the comment line of monitor files is skipped."""
    options = {"header": "true", "comment": "#"} if fmt == "csv" else {}
    return read(spark, path, schemas.EPISODE, fmt=fmt, **{**options, **kw})


def read_artifacts(spark: SparkSession, glob: str) -> DataFrame:
    """Files and their sidecars as (path, content, sidecar); content is null for files above Spark's binary limit."""
    from ..operators.artifacts import SIDECAR, with_sidecars

    files, large = sized_files(spark, glob)
    listing = files.select("path", "content").unionByName(large.withColumn("content", F.lit(None).cast("binary")))
    return with_sidecars(listing.where(~F.col("path").endswith(SIDECAR)), sidecars(spark, glob))


def sized_files(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """Files whose content can be read, and the paths of larger ones; the limit on length is pushed to the listing."""
    most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(2**31 - 1)))
    files = spark.read.format("binaryFile").load(glob)
    return files.where(F.col("length") <= most), files.where(F.col("length") > most).select("path")


def sidecars(spark: SparkSession, glob: str) -> DataFrame:
    """(path, sidecar) of the notes beside the files."""
    from ..operators.artifacts import SIDECAR

    notes = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SIDECAR}").load(glob)
    return notes.select(F.expr(f"left(path, length(path) - {len(SIDECAR)})").alias("path"), F.trim(F.col("content").cast("string")).alias("sidecar"))


def check_artifacts(spark: SparkSession, glob: str, key: bytes) -> DataFrame:
    """(path, verdict): files are hashed where they are read, and only hashes are joined with the notes."""
    from ..operators.artifacts import SIDECAR, hashed, verdict_of

    files, large = sized_files(spark, glob)
    mine = hashed(files.where(~F.col("path").endswith(SIDECAR)).select("path", "content"), key)
    mine = mine.unionByName(large.where(~F.col("path").endswith(SIDECAR)).withColumn("expected", F.lit(None).cast("string")))
    return mine.join(sidecars(spark, glob), "path", "left").select("path", verdict_of(F.col("expected"), F.col("sidecar")).alias("verdict"))


def defaults(spark: SparkSession, kind: str) -> DataFrame:
    if kind == "whitelist":
        return spark.createDataFrame([(n,) for n in DEFAULT_WHITELIST], schemas.WHITELIST)
    if kind == "topic_allow":
        return spark.createDataFrame([(t, n) for t, names in DEFAULT_TOPIC_ALLOW.items() for n in names], schemas.TOPIC_ALLOW)
    if kind == "waypoints":
        return spark.createDataFrame(DEFAULT_WAYPOINTS, schemas.WAYPOINT)
    if kind == "obstacles":
        return spark.createDataFrame(DEFAULT_OBSTACLES, schemas.OBSTACLE)
    raise ValueError(f"unknown reference table: {kind}")


def reference_table(spark: SparkSession, kind: str, path: str | None = None, fmt: str = "csv") -> DataFrame:
    """A small configuration table; the default where the file is missing or empty."""
    if path is None:
        return defaults(spark, kind)
    schema = {"whitelist": schemas.WHITELIST, "topic_allow": schemas.TOPIC_ALLOW, "waypoints": schemas.WAYPOINT, "obstacles": schemas.OBSTACLE}[kind]
    try:
        given = read(spark, path, schema, fmt=fmt, **({"header": "true"} if fmt == "csv" else {}))
        return defaults(spark, kind) if given.isEmpty() else given
    except Exception as e:  # missing path is reported by name, not by type
        if "PATH_NOT_FOUND" in str(e):
            return defaults(spark, kind)
        raise
