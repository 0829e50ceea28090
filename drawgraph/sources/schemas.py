"""Explicit schemas of the files. ``props`` is free-form and read as JSON text."""

NODE = (
    "id string, type string, subtype string, tag string, layer string, status string, service string, loop_id string, "
    "signal_type string, off_page_ref string, off_page_doc_id string, ports array<struct<id:string,dir:string>>, props string"
)
EDGE = (
    "id string, `from` string, `to` string, kind string, line_tag string, pipe_class string, diameter string, fluid_code string, "
    "flow_dir string, layer string, status string, props string"
)
_struct = lambda ddl: "struct<" + ddl.replace(" array", ":array").replace(" string", ":string") + ">"
GRAPH = f"schema_version string, nodes array<{_struct(NODE)}>, edges array<{_struct(EDGE)}>, _corrupt_record string"
COMPONENT = "struct<id:string,type:string,subtype:string,tag:string,label:string,props:string>"
CONNECTION = "struct<id:string,`from`:string,`to`:string,kind:string,line_tag:string,pipe_class:string,diameter:string,fluid_code:string>"
TILE = f"tile string, pass int, components array<{COMPONENT}>, connections array<{CONNECTION}>, _corrupt_record string"
EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
