"""Recorded answers to twelve worked examples, in our own trees: what a model should make of each text."""

from __future__ import annotations

from dataclasses import dataclass


def place(name: str, lon: float, lat: float, radius_km: float, region: str | None = None, country: str | None = None) -> dict:
    out = {"node_type": "NamedPlace", "name": name, "center_lon": lon, "center_lat": lat, "radius_km": radius_km}
    return out | ({"in_region": region} if region else {}) | ({"in_country": country} if country else {})


def side(direction: str, km: float, child: dict) -> dict:
    return {"node_type": "DirectionalConstraint", "direction": direction, "max_distance_km": km, "child_node": child}


@dataclass(frozen=True)
class Example:
    text: str
    tree: dict

    @property
    def root(self) -> str:
        return self.tree["node_type"]

    def _walk(self, tree: dict) -> list[dict]:
        kids = [tree[k] for k in ("child_node", "child_node_1", "child_node_2") if k in tree] + tree.get("child_nodes", [])
        return [tree, *[n for k in kids for n in self._walk(k)]]

    @property
    def nodes(self) -> int:
        return len(self._walk(self.tree))

    @property
    def places(self) -> str:
        return ",".join(n["name"] for n in self._walk(self.tree) if n["node_type"] == "NamedPlace")


_SQUARE = place("天安门广场", 116.3975, 39.9087, 0.5, "Beijing", "China")
_FRANCE, _SPAIN, _GERMANY = place("France", 2.2, 46.6, 500), place("Spain", -3.7, 40.2, 500), place("Germany", 10.4, 51.1, 400)
_GUANGDONG = place("Guangdong", 113.3, 23.4, 300, country="China")

EXAMPLES = [
    Example("深圳大学", place("深圳大学", 113.937, 22.533, 1, "Guangdong", "China")),
    Example("深圳大学西南方向的公园", place("荔香公园", 113.925, 22.533, 0.5, "Guangdong", "China")),
    Example("天安门广场西北方向", {"node_type": "Intersection", "child_nodes": [side("north", 5, _SQUARE), side("west", 5, _SQUARE)]}),
    Example("上海外滩附近3公里", {"node_type": "Buffer", "distance_km": 3, "child_node": place("外滩", 121.49, 31.24, 0.5, "Shanghai", "China")}),
    Example("四川和云南的交界处", {"node_type": "Intersection", "child_nodes": [place("Sichuan", 102.9, 30.1, 400, country="China"), place("Yunnan", 101.5, 25.0, 400, country="China")]}),
    Example("深圳市人才公园中人才星光桥与内地围成的深圳湾内湖", place("深圳人才公园内湖", 113.944, 22.514, 0.3, "Guangdong", "China")),
    Example("北京故宫东边的地铁站", place("天安门东站", 116.401, 39.908, 0.2, "Beijing", "China")),
    Example("广东省除了深圳", {"node_type": "Difference", "child_node_1": _GUANGDONG, "child_node_2": place("深圳", 114.06, 22.55, 40, "Guangdong", "China")}),
    Example("法国和西班牙的边界", {"node_type": "BorderBetween", "child_node_1": _FRANCE, "child_node_2": _SPAIN}),
    Example("法国和德国", {"node_type": "Union", "child_nodes": [_FRANCE, _GERMANY]}),
    Example("法国的海岸线", {"node_type": "CoastOf", "child_node": _FRANCE}),
    Example("法国海岸外10公里", {"node_type": "OffTheCoastOf", "distance_km": 10, "child_node": _FRANCE}),
]
