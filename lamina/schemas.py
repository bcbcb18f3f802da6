"""Schemas of the layout tables."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)


def _table(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


TEXT, LONG, INT, REAL, FLAG = StringType(), LongType(), IntegerType(), DoubleType(), BooleanType()

GEOMETRIES = _table(CellName=TEXT, Layer=LONG, DataType=LONG, ShapeType=TEXT, X_JSON=TEXT, Y_JSON=TEXT)
INSTANCES = _table(
    CellName=TEXT, RefCellName=TEXT, X=REAL, Y=REAL, MAG=REAL, ANGLE=REAL, IsXReflect=FLAG, IsArray=FLAG,
    Columns=LONG, Rows=LONG, DX=REAL, DY=REAL,
)
ENRICHED_INSTANCES = StructType(
    INSTANCES.fields + _table(inum=LONG, CellNumber=LONG, RefCellNumber=LONG, InstanceName=TEXT).fields
)
TEXTLABELS = _table(CellName=TEXT, Layer=LONG, TextType=LONG, X=REAL, Y=REAL, Label=TEXT)
BBOX = _table(CellName=TEXT, XMIN=REAL, YMIN=REAL, XMAX=REAL, YMAX=REAL)
DEFCOMPONENTS = _table(InstanceName=TEXT, CellName=TEXT, X=INT, Y=INT, Orientation=TEXT)
PARENTCHILD = _table(CellName=TEXT, ChildrenNum=ArrayType(LONG), CellNumber=LONG)
RELABEL = _table(Name=TEXT, Number=LONG)

LAYOUT_TABLES = {
    "geometries": GEOMETRIES,
    "instances": INSTANCES,
    "textlabels": TEXTLABELS,
    "bbox": BBOX,
    "defcomponents": DEFCOMPONENTS,
    "parentchild": PARENTCHILD,
}
