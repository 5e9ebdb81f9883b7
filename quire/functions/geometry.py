"""Coordinates: view space (as displayed, y down) and user space (as stored, y up)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Columns of a page box: origin_x, origin_y, box_width, box_height, box_rotation.


def box_columns(rotation: Column) -> list[Column]:
    """Page-box columns renamed so that they never clash with a rectangle's."""
    return [
        F.col("origin_x"),
        F.col("origin_y"),
        F.col("width").alias("box_width"),
        F.col("height").alias("box_height"),
        rotation.alias("box_rotation"),
    ]


def _by_turn(at0: Column, at90: Column, at180: Column, at270: Column) -> Column:
    turn = F.col("box_rotation")
    return F.when(turn == 90, at90).when(turn == 180, at180).when(turn == 270, at270).otherwise(at0)


def view_to_user(x: Column, y: Column) -> tuple[Column, Column]:
    """A displayed point in the page's own coordinates."""
    w, h = F.col("box_width"), F.col("box_height")
    return (
        _by_turn(x, y, w - x, w - y) + F.col("origin_x"),
        _by_turn(h - y, x, y, h - x) + F.col("origin_y"),
    )


def user_to_view(x: Column, y: Column) -> tuple[Column, Column]:
    """The inverse of :func:`view_to_user`."""
    w, h = F.col("box_width"), F.col("box_height")
    ux, uy = x - F.col("origin_x"), y - F.col("origin_y")
    return _by_turn(ux, uy, w - ux, h - uy), _by_turn(h - uy, ux, uy, w - ux)


def rect_to_user(x: Column, y: Column, width: Column, height: Column) -> list[Column]:
    """A displayed rectangle as x, y, width, height in user space."""
    ax, ay = view_to_user(x, y)
    bx, by = view_to_user(x + width, y + height)
    return [F.least(ax, bx), F.least(ay, by), F.abs(bx - ax), F.abs(by - ay)]


def view_size() -> tuple[Column, Column]:
    quarter = F.col("box_rotation").isin(90, 270)
    w, h = F.col("box_width"), F.col("box_height")
    return F.when(quarter, h).otherwise(w), F.when(quarter, w).otherwise(h)
