from __future__ import annotations

import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from revlake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "revlake-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


JD_PRODUCT, TMALL_PRODUCT = "777001", "888002"

JD_REVIEWS = [
    {
        "id": 41, "guid": "g-41", "content": "  键盘手感很好，灯光漂亮，值得推荐！ ",
        "creationTime": "2023-05-01 08:00:00", "score": 5, "nickname": "nick1",
        "userClientShow": "client A", "userLevelName": "gold", "usefulVoteCount": 3, "extra": {"k": 1},
    },
    {
        "id": 0, "guid": "g-42", "content": "键帽掉色，客服态度差，很失望。",
        "creationTime": "2023-5-2 9:1:2", "score": "1", "nickname": "nick2",
        "userClientShow": "", "userLevelName": None, "usefulVoteCount": "x",
    },
    {
        "id": "43", "content": None, "creationTime": "yesterday", "score": 4.7,
        "usefulVoteCount": "5.0",
    },
]
TMALL_REVIEWS = [
    {
        "id": "t1", "tradeId": "r1", "rateContent": "面料舒适，做工精致", "rateDate": "2023-06-01 10:20",
        "displayUserNick": "", "userVipLevel": "V1",
    },
    {
        "id": "", "tradeId": "r2", "rateContent": "有色差，退货了", "rateDate": "2023-06-02 10:20:30",
        "displayUserNick": "u2", "userVipLevel": "V2",
    },
]


def jd_name(page: int, product: str = JD_PRODUCT) -> str:
    return (
        f"club.jd.com__comment_productPageComments.action__productId-{product}"
        f"_score-0_sortType-5_page-{page}_pageSize-10_isShadowSku-0.txt"
    )


def tmall_name(page: int, product: str = TMALL_PRODUCT) -> str:
    return f"rate.tmall.com__list_detail_rate.htm__itemId-{product}_currentPage-{page}_order-3.txt"


def jd_body(reviews: list) -> str:
    return "\n fetchJSON_comment98(" + json.dumps({"comments": reviews}, ensure_ascii=False) + ");\n"


def tmall_body(reviews: list | None) -> str:
    return json.dumps({"rateDetail": {"rateList": reviews}}, ensure_ascii=False)


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / jd_name(0)).write_text(jd_body(JD_REVIEWS[:2]), encoding="utf-8")
    (folder / jd_name(1)).write_text(jd_body(JD_REVIEWS[2:]), encoding="utf-8")
    (folder / jd_name(2)).write_text(jd_body([]), encoding="utf-8")
    (folder / jd_name(3)).write_text(jd_body([{"id": 99, "content": "late"}]), encoding="utf-8")
    (folder / tmall_name(1)).write_text(tmall_body(TMALL_REVIEWS), encoding="utf-8")
    (folder / tmall_name(2)).write_text(tmall_body(None), encoding="utf-8")
    return folder


def rows(df, *columns):
    """Collected rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
