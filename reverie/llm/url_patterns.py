"""The pattern set of the URL filter, in filter syntax: advertising, tracking, spam, gambling, adult, malware and pages without text.

Lines of one kind that differ by a word are made from lists of words and of shapes.
"""

from __future__ import annotations

from itertools import product

#: Labels of hosts that serve advertising or count visits, at the start of a host or of any of its labels.
SERVING_LABELS = ("ad", "adclick", "adimg", "adserv", "adserver", "adsrv", "adview", "affiliates", "banner", "banners", "beacon", "clicks", "clicktrack", "pixel", "popads", "popunder", "retarget", "tracker", "trk", "webstats")

#: Folders of advertising and counting, anywhere in a path.
SERVING_FOLDERS = ("adbanners", "adclick", "adframe", "adimages", "adserver", "advert-frame", "banner-ads", "bannerads", "clickthru", "doubleads", "pagead", "popunders", "sponsored-links", "text-ads", "tracking-pixel")

#: What spam sells, in hosts and paths.
GOODS = ("buy-cialis", "buy-levitra", "buy-xanax", "cheap-pills", "cheap-viagra", "counterfeit-watches", "fake-diploma", "fake-passport", "hair-loss-cure", "herbal-viagra", "instagram-followers", "miracle-diet", "payday-loan", "penny-auction", "replica-handbags", "replica-watches", "weight-loss-pills")

#: Games for money, in hosts and paths.
GAMES = ("baccarat", "betting-tips", "blackjack-online", "casino-bonus", "free-spins", "online-bingo", "online-casino", "poker-online", "slot-machines", "sportsbook")

#: Words of sites for adults, in hosts and paths.
ADULT = ("adult-dating", "camgirls", "escort-service", "hentai", "live-sex", "milf", "nude-cams", "sex-chat", "xxx")

#: Words of pages that pass around stolen work.
PIRATED = ("crack-download", "cracked-apk", "full-movie-free", "keygen", "nulled-scripts", "serial-keys", "warez")

#: Shapes of a word in a host (its own label, a label's start, the end of a site's name) and in a path (a whole part, a part's start or end).
HOST_SHAPES = ("||{}.", "||{}-*.", "-{}.com^", "-{}.net^", "-{}.info^")
PATH_SHAPES = ("/{}^", "/{}-", "-{}/")

#: Patterns that no rule makes.
SINGLE = """
/ad/*/banner^
/ads/*.js|
/ads/banner*/
/adsense*.html|
/affiliate/*/click^
/affiliate/redirect^
/analytics/collect|
/banner_*x*.gif|
/banners/*.swf|
/beacon/*.gif|
/cgi-bin/clickthru^
/click/track/*/out^
/count/*/pixel.png|
/email/open/*.gif|
/impression/*.gif|
/go/*/offer^
/out/*/partner^
/pixel.gif|
/pixel/*.png|
/popup/*/ad.html|
/spacer.gif|
/sponsor/*/click^
/stats/hit*.gif|
/track/*/open^
/tracking/*/click^
/__utm.gif|
/account/verify-*/login^
/secure-login/*/update^
/signin/*/confirm-identity^
/webscr/*/login^
/wp-content/*/redirect.php|
/wp-includes/*.exe|
/download/*.exe|
/download/*.scr|
/free-download/*.apk|
/flash-update/*.exe|
/install/*/codec^
/add-to-cart^
/basket/checkout^
/calendar/*/*/*/ical^
/cart/checkout^
/cgi-bin/search^
/comment/reply/*/
/feed/*/rss.xml|
/forgot-password^
/member/login^
/password-reset/
/print/*/print.html|
/search/*/page/*/
/shop/cart^
/tag/*/feed^
/user/login^
/user/register^
/wp-admin/
/wp-json/*/oembed^
/wp-login.php|
/xmlrpc.php|
||click.*.*/redirect^
||go.*/out/
||mail.*/unsubscribe^
||m.*/interstitial^
||phish*.*/login^
||secure-*.*/signin/*/verify^
||track.*/click^
||win-*.*/prize^
||your-*-winner.
"""

#: What is let through though a pattern above fits.
EXCEPTIONS = """
@@/history/*/blackjack-online^
@@/history/*/online-bingo^
@@/law/*/payday-loan^
@@/law/*/payday-loan-
@@/news/*/online-casino-
@@/news/*/payday-loan-
@@/news/*/sportsbook-
@@/research/*/sex-chat-
@@/research/*/weight-loss-pills^
@@/wiki/hentai|
@@/wiki/keygen|
@@/wiki/sportsbook|
@@/wiki/warez|
@@||banner.*.edu^
@@||beacon.*.gov^
@@||pixel.*.museum^
@@||tracker.*.gov^
@@||who.int^*/weight-loss-pills
"""


def pattern_lines() -> tuple[str, ...]:
    """All lines, each once, in order of the alphabet."""
    made = {f"||{label}." for label in SERVING_LABELS} | {f"/{folder}/" for folder in SERVING_FOLDERS}
    made |= {shape.format(word) for word, shape in product(GOODS + GAMES + ADULT + PIRATED, HOST_SHAPES + PATH_SHAPES)}
    return tuple(sorted(made | set(SINGLE.split()) | set(EXCEPTIONS.split())))
