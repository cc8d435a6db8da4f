import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

EDGE_CSV = """ID;MAC_CODE;t;Rotor_speed;Rotor_speed_min;Rotor_speed_max;Rotor_speed_std;Pitch_angle;Pitch_angle_std;Grid_voltage;Nacelle_angle;TARGET
1;WT1;0;0.0;0.0;0.1;0.05;0.0;0.0;380.0;0.0;-3.0
2;WT1;10;0.0;0.0;0.0;0.0;45.0;0.2;;360.0;0.05
3;WT1;20;2.5;2.0;3.0;0.3;44.0;0.5;385.0;32.7;0.1
4;WT1;30;3.5;3.0;4.0;0.3;-1.0;0.4;;32.8;12.0
5;WT1;40;8.5;8.0;9.0;0.4;-1.0;0.1;390.0;180.0;110.0
6;WT1;50;8.6;8.0;9.0;0.4;-0.5;0.1;390.0;180.0;112.0
7;WT2;0;14.9;14.0;15.5;0.6;-0.9;0.3;;90.0;560.0
8;WT2;10;15.0;14.5;15.2;0.2;-0.8;0.2;400.0;90.0;700.0
9;WT2;20;16.0;15.5;16.5;0.2;0.0;0.2;400.0;270.0;1000.0
10;WT2;30;16.0;15.5;16.5;0.2;1.0;0.2;400.0;270.0;1100.0
11;WT2;40;17.0;16.0;17.2;0.3;5.0;1.0;;300.0;1900.0
12;WT2;50;;;;;2.0;0.2;400.0;;55.0
13;WT3;0;10.0;11.0;12.0;0.4;-1.0;0.1;395.0;200.0;180.0
14;WT3;10;10.0;9.0;9.5;0.4;-1.0;0.1;395.0;200.0;260.0
15;WT3;20;10.0;12.0;8.0;0.4;-1.0;0.1;;200.0;181.0
16;WT3;40;12.0;12.0;12.0;0.0;-1.0;0.1;396.0;-5.0;300.0
17;WT3;30;12.0;12.0;12.0;0.1;-1.0;0.1;396.0;365.0;301.0
18;WT4;0;5.0;4.5;5.5;0.2;-119.0;0.1;380.0;10.0;-25.0
19;WT4;10;5.0;4.5;5.5;0.2;119.0;0.1;;10.0;-20.0
20;WT4;20;5.0;4.5;5.5;;0.5;0.1;380.0;10.0;30.0
21;WT4;30;-0.1;-0.2;0.0;0.1;90.0;0.1;380.0;10.0;0.0
22;;0;9.0;8.5;9.5;0.3;-1.0;0.1;390.0;45.0;150.0
23;WTx;0;9.0;8.5;9.5;0.3;-1.0;0.1;390.0;45.0;151.0
24;WT3;50;11.0;10.0;12.0;0.2;;;;;
"""


@pytest.fixture(scope="session")
def spark():
    from gustframe.session import get_session
    return get_session(master="local[4]", shuffle_partitions=8)


@pytest.fixture(scope="session")
def edge(spark):
    """The hand-made 24-row edge table (FIXTURES.md section 3)."""
    from pyspark.sql import types as T
    lines = EDGE_CSV.strip().splitlines()
    names = lines[0].split(";")
    schema = T.StructType([T.StructField("ID", T.LongType()), T.StructField("MAC_CODE", T.StringType()),
                           T.StructField("t", T.LongType())] +
                          [T.StructField(n, T.DoubleType()) for n in names[3:]])
    rows = []
    for ln in lines[1:]:
        v = ln.split(";")
        row = [int(v[0]), v[1] or None, int(v[2])] + [float(x) if x != "" else None for x in v[3:]]
        rows.append(tuple(row))
    return spark.createDataFrame(rows, schema).cache()
