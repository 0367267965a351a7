"""Default configuration of a run; every operator takes its values as parameters."""

from __future__ import annotations

#: Categories, the tags that find their markets, and their feeds.
CATEGORIES = {
    "nfl": {
        "tags": ["nfl", "nfl-playoffs", "super-bowl"],
        "espn_sport": "football/nfl",
        "rss": [("https://www.espn.com/espn/rss/nfl/news", "espn_nfl"), ("https://apnews.com/apf-sports.rss", "ap_sports")],
    },
    "nba": {
        "tags": ["nba", "nba-finals", "nba-playoffs"],
        "espn_sport": "basketball/nba",
        "nba_stats": True,
        "rss": [("https://www.espn.com/espn/rss/nba/news", "espn_nba"), ("https://apnews.com/apf-sports.rss", "ap_sports")],
    },
    "politics": {
        "tags": ["politics", "elections", "us-politics"],
        "rss": [("https://feeds.reuters.com/Reuters/PoliticsNews", "reuters_politics"), ("https://rss.politico.com/politics-news.xml", "politico")],
    },
    "geopolitics": {
        "tags": ["geopolitics", "world", "international"],
        "rss": [("https://feeds.reuters.com/Reuters/worldNews", "reuters_world"), ("https://apnews.com/apf-intlnews.rss", "ap_world")],
    },
}
#: The window of a run and the bounds of its universe.
FOCAL = {"categories": ["nfl", "nba"], "start_date": "2024-08-01", "end_date": "2025-06-01", "min_volume_usdc": 10_000, "min_market_duration_days": 30}
#: The terms that a category's knowledge-graph rows hold.
TERMS = {
    "nfl": (
        "NFL, National Football League, Super Bowl, Kansas City Chiefs, Philadelphia Eagles, San Francisco 49ers, Dallas Cowboys, "
        "New England Patriots, Buffalo Bills, Miami Dolphins, Baltimore Ravens, Cincinnati Bengals, Cleveland Browns, Pittsburgh Steelers, "
        "Houston Texans, Indianapolis Colts, Jacksonville Jaguars, Tennessee Titans, Denver Broncos, Las Vegas Raiders, Los Angeles Chargers, "
        "New York Giants, New York Jets, Washington Commanders, Chicago Bears, Detroit Lions, Green Bay Packers, Minnesota Vikings, "
        "Atlanta Falcons, Carolina Panthers, New Orleans Saints, Tampa Bay Buccaneers, Patrick Mahomes, Josh Allen, Jalen Hurts"
    ).split(", "),
    "nba": (
        "NBA, National Basketball Association, NBA Finals, Los Angeles Lakers, Boston Celtics, Golden State Warriors, Milwaukee Bucks, "
        "Miami Heat, Denver Nuggets, Phoenix Suns, Dallas Mavericks, Oklahoma City Thunder, Sacramento Kings, Minnesota Timberwolves, "
        "New Orleans Pelicans, Memphis Grizzlies, New York Knicks, Brooklyn Nets, Philadelphia 76ers, Toronto Raptors, Chicago Bulls, "
        "Atlanta Hawks, Charlotte Hornets, Washington Wizards, Cleveland Cavaliers, Detroit Pistons, Indiana Pacers, San Antonio Spurs, "
        "Houston Rockets, Portland Trail Blazers, Utah Jazz, Los Angeles Clippers, LeBron James, Stephen Curry, Nikola Jokic"
    ).split(", "),
}


def terms(categories: list[str]) -> list[str]:
    """The terms of some categories in order, each once."""
    return list(dict.fromkeys(t for c in categories for t in TERMS.get(c, ())))


def tags(categories: list[str]) -> dict[str, list[str]]:
    """The tags of some categories."""
    return {c: CATEGORIES[c]["tags"] for c in categories}
