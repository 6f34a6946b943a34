"""Schemas of the record model."""

from pyspark.sql import types as T

ALBUM = "collection_id long, wrapper_type string, collection_type string, artist_id long, artist_name string, collection_name string, collection_view_url string, collection_explicitness string, track_count int, country string, release_date timestamp_ntz, primary_genre_name string"
TRACK = "track_id long, artist_id long, collection_id long, artist_name string, collection_name string, track_name string, collection_artist_name string, artwork_url string, track_explicitness string, disc_count int, disc_number int, track_count int, track_number int, track_time_millis int, primary_genre_name string, isrc string"
ARTIST = "artist_id long, artist_name string, artist_type string, artist_link_url string, amg_artist_id long, primary_genre_name string, primary_genre_id int"
RAW = "input_pos long, title string, artist string, album string, release_year int, upload_date string, track_number int, thumbnail string, isrc string, video_id string, playlist_id string, playlist_title string, is_ytmusic boolean, duration double, uploader string"

_TAG = "array<struct<name:string,count:int>>"
_CREDIT = "array<struct<name:string,joinphrase:string,artist:struct<id:string,name:string>>>"
RECORDING = (
    f"id string, title string, length int, isrcs array<string>, `first-release-date` string, `artist-credit` {_CREDIT}, genres {_TAG}, tags {_TAG}, "
    "releases array<struct<id:string,title:string,date:string,country:string,"
    f"`release-group`:struct<id:string,`primary-type`:string,`first-release-date`:string,genres:{_TAG},tags:{_TAG}>,genres:{_TAG},tags:{_TAG},"
    "`label-info`:array<struct<label:struct<name:string>>>,`artist-credit`:array<struct<name:string,artist:struct<id:string>>>,"
    "media:array<struct<position:int,title:string,tracks:array<struct<number:string,title:string>>>>>>"
)

#: Public fields of the output record.
META = {
    "title": "string", "artist": "string", "album": "string", "album_artist": "string", "year": "string", "genre": "string", "label": "string", "country": "string", "artist_collection": "string",
    "raw_artist_name": "string", "composer": "string", "copyright": "string", "track_number": "int", "disc_number": "int", "total_tracks": "int", "total_discs": "int", "explicit": "boolean",
    "compilation": "boolean", "media_type": "int", "matched": "boolean", "duration_ms": "int", "cover_url": "string", "preview_url": "string", "isrc": "string", "upc": "string", "video_id": "string",
    "sort_title": "string", "sort_artist": "string", "sort_album": "string", "sort_album_artist": "string", "itunes_track_id": "string", "itunes_artist_id": "string", "itunes_collection_id": "string",
    "mb_track_id": "string", "mb_album_id": "string", "mb_artist_id": "string", "mb_album_artist_id": "string", "mb_release_group_id": "string",
}


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
