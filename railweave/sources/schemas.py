"""Schemas of all sources; nothing is inferred.

Fixed values: the field names are those of the files that are read.
"""

CODES = "array<struct<system:string,code_type:string,code:string>>"
STATIONS = "id long, kind string, name string, tags map<string,string>, lat double, lon double"
_STATION = "struct<title:string,longitude:string,latitude:string,transport_type:string,station_type:string,codes:struct<yandex_code:string,esr_code:string>>"
STATION_TREE = f"countries array<struct<title:string,regions:array<struct<title:string,settlements:array<struct<title:string,stations:array<{_STATION}>>>>>>>"
_ELEMENT = "struct<type:string,id:long,lat:double,lon:double,center:struct<lat:double,lon:double>,members:array<struct<type:string,ref:long,role:string>>,tags:map<string,string>>"
MAP_FILE = f"elements array<{_ELEMENT}>"
_BLOCK = "struct<days:string,dep:array<string>,dwell:array<string>,arr:array<string>,period:string>"
REGISTRY = (
    "meta struct<source:string,snapshot:string>,"
    "routes array<struct<reg:string,name:string,order:double,carrier:string,carrier_inn:string,carrier_ogrn:string,carrier_address:string,carrier_email:string>>,"
    "stops array<struct<id:string,name:string,region:string,op_reg:string,lat:double,lon:double>>,"
    "carriers array<struct<name:string,inn:string,ogrn:string,address:string,email:string>>,"
    "services array<struct<id:long,name:string,start_date:string,end_date:string>>,"
    "service_days array<struct<service_id:long,weekday:int>>,"
    "service_exceptions array<struct<service_id:long,date:string,exception_type:string>>,"
    f"schedules array<struct<route:string,direction:string,service_id:long,stops:array<struct<stop:string,region:string,winter:{_BLOCK},summer:{_BLOCK}>>>>"
)
FEED = {
    "stops": ["stop_id", "stop_code", "stop_name", "stop_lat", "stop_lon"],
    "calendar": ["service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"],
    "calendar_dates": ["service_id", "date", "exception_type"],
    "routes": ["route_id", "agency_id", "route_short_name", "route_long_name", "route_type"],
    "trips": ["route_id", "service_id", "trip_id", "direction_id"],
    "frequencies": ["trip_id", "start_time", "end_time", "headway_secs"],
    "stop_times": ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"],
}
OPTIONAL = ("calendar_dates", "frequencies")
PLACES = "name string, aliases array<string>, lat double, lon double"
THREADS = "thread_id string, number string, title string, uid string, transport_type string, date string, stops array<struct<code:string,title:string,arrival:string,departure:string>>"
