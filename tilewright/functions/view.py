"""A view of the map as columns: pixels of the world, of the layers' plane and of the container, there and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions import camera, geo

# The bounds of the projections' planes (minx, miny, maxx, maxy).
PLANES = {
    "EPSG:3857": (-geo.MERCATOR_RADIUS * geo.HALF_PI * 2, -geo.MERCATOR_RADIUS * geo.HALF_PI * 2, geo.MERCATOR_RADIUS * geo.HALF_PI * 2, geo.MERCATOR_RADIUS * geo.HALF_PI * 2),
    "EPSG:900913": (-geo.MERCATOR_RADIUS * geo.HALF_PI * 2, -geo.MERCATOR_RADIUS * geo.HALF_PI * 2, geo.MERCATOR_RADIUS * geo.HALF_PI * 2, geo.MERCATOR_RADIUS * geo.HALF_PI * 2),
    "EPSG:3395": (-20037508.34279, -15496570.73972, 20037508.34279, 18764656.23138),
    "EPSG:4326": (-180.0, -90.0, 180.0, 90.0),
}


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def projected_bounds(crs: geo.Crs, zoom: Column | float) -> Column:
    """The box of the whole plane of a projection in pixels of a zoom; null for a projection without bounds."""
    if crs.name not in PLANES:
        return F.lit(None).cast("struct<minx:double,miny:double,maxx:double,maxy:double>")
    minx, miny, maxx, maxy = PLANES[crs.name]
    s = crs.scale(zoom)
    xs = [s * (crs.a * v + crs.b) for v in (minx, maxx)]
    ys = [s * (crs.c * v + crs.d) for v in (miny, maxy)]
    return geo.box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


@dataclass(frozen=True)
class View:
    """A view: its centre, zoom and size, where its pane has been dragged to, and how it is turned and tilted (degrees)."""

    lat: Column
    lng: Column
    zoom: Column
    width: float
    height: float
    pane: Column | None = None
    bearing: Column | None = None
    pitch: Column | None = None
    crs: geo.Crs = geo.EPSG3857

    @property
    def _pane(self) -> Column:
        return _point(F.lit(0.0), F.lit(0.0)) if self.pane is None else self.pane

    @property
    def _middle(self) -> Column:
        return _point(F.lit(self.width / 2), F.lit(self.height / 2))

    def origin(self) -> Column:
        """The pixel of the world where the layers' plane begins: whole pixels."""
        x, y = self.crs.to_pixel(self.lat, self.lng, self.zoom)
        return geo.point_rounded(geo.point_add(geo.point_subtract(_point(x, y), self._middle), self._pane))

    def pixel_bounds(self) -> Column:
        """The box of world pixels that the view shows."""
        top = geo.point_subtract(self.origin(), self._pane)
        return geo.box(top.x, top.y, top.x + self.width, top.y + self.height)

    def to_layer(self, lat: Column, lng: Column) -> Column:
        """A place on the layers' plane, in whole pixels."""
        return geo.point_subtract(geo.point_rounded(_point(*self.crs.to_pixel(lat, lng, self.zoom))), self.origin())

    def from_layer(self, p: Column) -> tuple[Column, Column]:
        """Latitude and longitude of a point of the layers' plane."""
        at = geo.point_add(p, self.origin())
        return self.crs.from_pixel(at.x, at.y, self.zoom)

    def layer_to_container(self, p: Column) -> Column:
        """Turned around the view's middle, then tilted, then moved with the pane."""
        if self.bearing is None and self.pitch is None:
            return geo.point_add(p, self._pane)
        off, zero = geo.point_subtract(p, self._middle), _point(F.lit(0.0), F.lit(0.0))
        if self.bearing is not None:
            off = camera.rotated(off, self.bearing, zero)
        if self.pitch is not None:
            off = camera.pitched(off, self.pitch, self.height)
        return geo.point_add(geo.point_add(off, self._middle), self._pane)

    def container_to_layer(self, p: Column) -> Column:
        """What layer_to_container() does, undone step by step."""
        if self.bearing is None and self.pitch is None:
            return geo.point_subtract(p, self._pane)
        off, zero = geo.point_subtract(geo.point_subtract(p, self._pane), self._middle), _point(F.lit(0.0), F.lit(0.0))
        if self.pitch is not None:
            off = camera.unpitched(off, self.pitch, self.height)
        if self.bearing is not None:
            off = camera.rotated(off, -self.bearing, zero)
        return geo.point_add(off, self._middle)

    def to_container(self, lat: Column, lng: Column) -> Column:
        """Where a place is seen in the container."""
        return self.layer_to_container(self.to_layer(lat, lng))

    def from_container(self, p: Column) -> tuple[Column, Column]:
        """Latitude and longitude of what is seen at a point of the container."""
        return self.from_layer(self.container_to_layer(p))
