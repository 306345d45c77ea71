"""In-memory knowledge-base API: two sections, one of them paged, one broken article."""

PAGES = {(7, 1): [1, 2], (7, 2): [3], (9, 1): [4, 5]}
LAST = {7: 2, 9: 1}


def transport(method, url, body, headers):
    path = url.split("kb.local/", 1)[1]
    if path.startswith("api/auth"):
        return (200, {"access_token": " t "}) if body["password"] == "p" else (403, None)
    if headers.get("Authorization") != "Bearer t":
        return 401, None
    if path.startswith("api/knowledgebase/tree"):
        return 200, {"a": {"type": "section", "id": 9}, "b": {"type": "section", "id": "7"}, "c": {"type": "page", "id": 1}}
    if "/section/" in path:
        section = int(path.split("/section/")[1].split("/")[0])
        page = int(path.split("page=")[1].split("&")[0])
        return 200, {"data": [{"id": i, "name": f"N{i}"} for i in PAGES[(section, page)]], "meta": {"last_page": LAST[section]}}
    i = int(path.rsplit("/", 1)[1])
    if i == 5:
        return 500, None
    return 200, {"data": {"id": i, "content": f"<p>text {i}</p>", "status": "archive" if i == 2 else "public", "updated_at": "2024-01-02"}}
