"""Record schemas as DDL; nothing is inferred. Unknown fields are ignored, absent ones are null."""

SEARCH_REQUEST = "contents array<struct<parts:array<struct<text:string>>,role:string>>, tools array<struct<google_search:struct<>>>"
SEARCH_RESPONSE = "candidates array<struct<content:struct<parts:array<struct<text:string>>,role:string>,groundingMetadata:struct<groundingChunks:array<struct<web:struct<uri:string,title:string>>>>>>, error struct<code:int,message:string>, _corrupt string"
SOURCE = "struct<url:string,title:string>"
GROUNDED_RESULT = f"answer string, sources array<{SOURCE}>"
RESEARCH_REQUEST = "request_id long, query string, depth int, lang string"
FAILED_URL = "url string, reason string"
FETCH_REQUEST = "request_id long, url string, js boolean, raw boolean"
FETCH_RESULT = "url string, markdown string, used_raw_fallback boolean"
ARTICLE = "title string, byline string, published_time string, content_html string, used_raw_fallback boolean"
#: A recorded HTTP exchange; failure is a network error's kind (Http, Timeout), null if there was a response.
HTTP_RESPONSE = "url string, final_url string, status int, content_type string, body binary, failure string"
RENDERED = "url string, stdout string, failure string"
RESOLVED = "host string, ip string"
#: A recorded API exchange: repository API paths, or chat methods with their parameters.
API_RESPONSE = "path string, status int, remaining long, body string"
REPO_INFO = "full_name string, description string, html_url string, default_branch string, language string, stargazers_count long, forks_count long, open_issues_count long, topics array<string>, license struct<spdx_id:string,name:string>"
TREE = "tree array<struct<path:string,type:string,size:long>>, truncated boolean"
CONTENTS = "sha string, content string"
BLOB = "content string"
USER = "struct<login:string>"
# pull_request is kept as JSON text: only its presence counts
ISSUES = f"array<struct<number:long,title:string,html_url:string,labels:array<struct<name:string>>,user:{USER},pull_request:string>>"
PULLS = f"array<struct<number:long,title:string,html_url:string,draft:boolean,user:{USER}>>"
RELEASES = "array<struct<tag_name:string,name:string,html_url:string,published_at:string,prerelease:boolean>>"
PERMALINK = "struct<workspace:string,channel:string,ts:string,thread_ts:string,raw_url:string>"
MESSAGE = "struct<user:string,text:string,ts:string,reply_count:long>"
#: Chat tables: messages of a channel; thread_ts is the first message's ts in a thread, null outside.
MESSAGES = "channel string, ts string, thread_ts string, user string, text string, reply_count long"
CHANNELS = "channel string, name string"
USERS = "user string, real_name string, display_name string"
RESOLVED_MESSAGE = "struct<author:string,text:string,ts:string>"
MENTION = "struct<user_id:string,start:int,end:int>"
