"""The dimension of structured-field types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Type id, abbreviation, whether diagnostics count it as known, icon, name.
_TYPES = """
D3A090 TLE known layers Tag Logical Element
D3A8A5 BPF known file Begin Print File
D3A9A5 EPF known file End Print File
D3A8A8 BDT known layers Begin Document
D3A9A8 EDT known layers End Document
D3A8AD BPG known file Begin Page
D3A9AD EPG known file End Page
D3A8AF BRS known box Begin Resource
D3A9AF ERS known box End Resource
D3A8C9 BAG known layers Begin Active Env Group
D3A9C9 EAG known layers End Active Env Group
D3A8C6 BOG known layers Begin Object Env Group
D3A9C6 EOG known layers End Object Env Group
D3A8CE BOC known box Begin Object Container
D3A9CE EOC known box End Object Container
D3A87B BPT known type Begin Presentation Text
D3A97B EPT known type End Presentation Text
D3A89B BPT known type Begin Presentation Text
D3A99B EPT known type End Presentation Text
D3EE9B PTX known type Presentation Text Data
D3EE6B PTX known type Presentation Text Data
D3EEEE NOP known file No Operation
D3A8C5 BIM known image Begin Image
D3A9C5 EIM known image End Image
D3A892 BII known image Begin IM Image
D3A992 EII known image End IM Image
D3EE92 IID known image IM Image Data
D3ACCE IDD known image Image Data Descriptor
D3EE7B IDE known image Image Data
D3A8C3 BGR known pen Begin Graphics
D3A9C3 EGR known pen End Graphics
D3EECC GAD known pen Graphics Data
D3A8EB BBC known barcode Begin Bar Code
D3A9EB EBC known barcode End Bar Code
D3AEEB BDD known barcode Bar Code Data Descriptor
D3A6AF PGD known file Page Descriptor
D3ABC3 MCF known type Map Coded Font
D3ABCE MIO known image Map Image Object
D3AC6B OBP known box Object Area Position
D3A6C3 OAD known box Object Area Descriptor
D3AFC3 IOC known box Include Object
D3B19B PTP known type Pres Text Position
D3A28A LND other type Line Descriptor
D3A688 MDD known file Medium Descriptor
D3A68A FDD other file Form Descriptor
D3ABCA BNG known layers Begin Named Group
D3A9CA ENG known layers End Named Group
D3A8A7 BAG known box Begin Object Area
D3A9A7 EAG known box End Object Area
D3A6EE FNC known type Font Control
D3A87E BFG known type Begin Font Resource Group
D3AFEE NOP known file No Operation
D3A8EE NOP known file No Operation
D3ABCC MCC known file Medium Copy Count
D3AB88 IMM known file Invoke Medium Map
D3ABD8 MPO known box Map Page Overlay
D3AFD8 IPO known box Include Page Overlay
D3AF5F IPS known box Include Page Segment
D3B15F MPS known box Map Page Segment
D3B18A MMC known file Medium Modification Control
D3EEBB OCD known box Object Container Data
D3A79B PEC known file Presentation Environment Control
D3A69B PFC known file Presentation Fidelity Control
D3A8BB BDI known layers Begin Document Index
D3A9BB EDI known layers End Document Index
D3A8C7 BDG known layers Begin Document Environment Group
D3A9C7 EDG known layers End Document Environment Group
D3A66B OAD known box Object Area Descriptor
D3A6BB IDD2 known file Index Element Descriptor
D3A888 BMM known file Begin Medium Map
D3A988 EMM known file End Medium Map
D3A88A BFM known file Begin Form Map
D3A98A EFM known file End Form Map
D3A885 BCF known type Begin Coded Font
D3A985 ECF known type End Coded Font
D3A887 BCS known type Begin Character Set
D3A987 ECS known type End Character Set
D3A889 BCP known type Begin Code Page
D3A989 ECP known type End Code Page
D3A8A6 BFN known type Begin Font
D3A9A6 EFN known type End Font
D3AB89 MCP known type Map Code Page
D3A8C4 BPS known box Begin Page Segment
D3A9C4 BPS known box End Page Segment
D3A8DF BOV known box Begin Overlay
D3A9DF EOV known box End Overlay
D3ABDF MOV known box Map Overlay
D3AB5F MFC other file Map Form Control
D3A65F FND other type Font Descriptor
D3A787 CPC other type Code Page Control
D3A689 CPD other type Code Page Descriptor
D3A687 CSD other type Character Set Descriptor
D3A686 CFD other type Coded Font Descriptor
D3EE89 CPI other type Code Page Index
D3A289 CPM other type Code Page Map
D3EE87 FNP other type Font Pattern
D3AE87 FNM other type Font Pattern Map
D3A85F BPS known box Begin Page Segment
D3A95F EPS known box End Page Segment
D3A8FB BII known image Begin Image (II)
D3A9FB EII known image End Image (II)
D3EEFB IRD known image Image Raster Data
D3ABFB MII known image Map Image (II)
D3A6FB IID known image Image Input Descriptor
D3A789 CPC known type Code Page Control
D3AE89 CPM known type Code Page Map
D3AC89 CPI known type Code Page Index
D38C89 CPF known type Code Page Font
D38C87 CSF known type Character Set Font
D3A8CD BII known image Begin IM Image Object
D3A9CD EII known image End IM Image Object
D3A8CC BOC known box Begin Object Container
D3A9CC EOC known box End Object Container
D3A6C5 MDD known file Medium Descriptor
D3B1AF PPO known box Preprocess Object
D3A288 MDR known file Medium Data Record
D3A788 MMC known file Medium Modification Control
D3AB8A MMC known file Map Medium Copy Count
"""

TYPES = [tuple(line.split(" ", 4)) for line in _TYPES.strip().splitlines()]
KNOWN = sorted(t[0] for t in TYPES if t[2] == "known")


def type_dim(spark: SparkSession) -> DataFrame:
    """type_id, abbrev, full_name, icon, known."""
    rows = [(i, a, n, icon, k == "known") for i, a, k, icon, n in TYPES]
    return spark.createDataFrame(rows, "type_id string, abbrev string, full_name string, icon string, known boolean")


def with_type_names(sf: DataFrame) -> DataFrame:
    """abbrev, full_name and icon of each field; unknown types are named by their id."""
    dim = F.broadcast(type_dim(sf.sparkSession))  # a fixed table of about a hundred rows
    return sf.join(dim, "type_id", "left").withColumns({
        "abbrev": F.coalesce("abbrev", "type_id"),
        "full_name": F.coalesce("full_name", F.concat(F.lit("Unknown ("), "type_id", F.lit(")"))),
        "icon": F.coalesce("icon", F.lit("file")),
        "known": F.coalesce("known", F.lit(False)),
    })


def is_begin(type_id: Column) -> Column:
    return (F.substring(type_id, 3, 2) == "A8") | (type_id == "D3ABCA")


def is_end(type_id: Column) -> Column:
    return F.substring(type_id, 3, 2) == "A9"
