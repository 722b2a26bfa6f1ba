"""Rows that the queries over fixed inputs must give."""

ROWS: dict[str, list[tuple]] = {
    'web_sitemaps': [
        (1, 'https://a.example/1', '2024-01-02', 'page', False),
        (1, 'https://a.example/2?x=1&y=2', None, 'page', False),
        (2, 'https://a.example/s1.xml', '2024-02-03T00:00:00Z', 'index', False),
        (3, 'https://a.example/1', '2024-01-02', 'page', False),
        (3, 'https://a.example/2?x=1&y=2', None, 'page', False),
        (4, 'https://a.example/cut', None, 'page', True),
    ],
    'web_sitemap_walk': [
        ('https://a.example/1', '2024-01-02'),
        ('https://a.example/2?x=1&y=2', None),
    ],
    'web_robots': [
        (1, 'disallowed'),
        (2, 'allowed'),
        (3, 'disallowed'),
        (4, 'allowed'),
        (5, 'allowed'),
        (6, 'no_policy'),
        (7, 'unavailable'),
        (8, 'unavailable'),
        (9, 'unavailable'),
    ],
    'web_named_routes': [
        ('robots', 'https://a.example/map.xml'),
        ('robots', 'https://a.example/two.xml'),
        ('page', 'https://a.example/feed'),
        ('page', 'https://a.example/map.xml'),
    ],
    'web_feeds': [
        (1, 't3_abc', 'First & best', 'https://a.example/r/x/1', 'ann', '2024-01-01T00:00:00Z'),
        (1, 't1_def', '', 'https://b.example/c', '', '2024-01-03T00:00:00Z'),
        (2, 'g1', 'Item', 'https://c.example/i', 'bob', 'Mon, 01 Jan 2024 00:00:00 GMT'),
        (2, 'https://a.example/', 'No link', 'https://a.example/', '', ''),
    ],
    'web_feed_urls': [
        ('python', 'https://www.reddit.com/r/python.rss', 'subreddit'),
        ('/r/python/', 'https://www.reddit.com/r/python.rss', 'subreddit'),
        ('https://old.reddit.com/r/python/?sort=new', 'https://www.reddit.com/r/python.rss?sort=new', 'subreddit'),
        ('https://www.reddit.com/r/python/comments/ab12/title/', 'https://www.reddit.com/comments/ab12.rss', 'thread'),
        ('https://www.reddit.com/r/python/search?q=x&y=', 'https://www.reddit.com/r/python/search.rss?q=x&y=', 'search'),
        ('https://www.reddit.com/user/ann.rss', 'https://www.reddit.com/user/ann.rss', 'subreddit'),
        ('r/spark ', 'https://www.reddit.com/r/spark.rss', 'subreddit'),
    ],
    'web_entry_kinds': [
        ('t1_a', 'comment'),
        ('t3_a', 'submission'),
        ('a', 'comment'),
        ('a', 'entry'),
        (None, 'entry'),
    ],
    'web_listing': [
        (0, 'One <b>', 'https://old.reddit.com/r/x/comments/1/a/', 'ann', '12', '3 comments'),
        (1, 'Two', 'https://b.example/', 'bob', '7', ''),
    ],
    'web_listing_markdown': [
        ('1. [One <b>](https://old.reddit.com/r/x/comments/1/a/) · 12 points · ann · 3 comments\n2. [Two](https://b.example/) · 7 points · bob · 0 comments',),
    ],
    'web_listing_urls': [
        ('https://www.reddit.com/r/x/?a=1#b', 'https://old.reddit.com/r/x/?a=1#b'),
        ('https://reddit.com', 'https://old.reddit.com'),
        ('https://old.reddit.com/r/x', 'https://old.reddit.com/r/x'),
        ('https://np.reddit.com/r/x/comments/1/t', 'https://np.reddit.com/r/x/comments/1/t'),
        ('https://notreddit.com/r/x', 'https://notreddit.com/r/x'),
        ('http://m.reddit.com:80/user/y', 'http://old.reddit.com/user/y'),
        ('no url', 'no url'),
    ],
    'web_records': [
        ('t3_a', 'T', 'summary', 'ann', 'https://x/1', '2024', 'reddit', 'reddit_rss'),
        ('t1_b', '', 'content', '', 'https://x/2', '', 'reddit', 'reddit_rss'),
        ('p1', 'Post', 'text', 'bob', 'https://www.reddit.com/r/x/comments/p1', '1704067200', 'reddit', 'arctic_shift'),
        ('c1', '', 'comment', 't2_x', 'https://y/2', '5', 'reddit', 'arctic_shift'),
        ('', '', '', '', '', '', 'reddit', 'arctic_shift'),
        ('n', '', '', '', '', '', 'reddit', 'arctic_shift'),
    ],
    'web_media_entries': [
        (' v1 ', 'T', '7', 'https://www.youtube.com/watch?v=v1'),
        ('v2', None, None, 'https://m.example/v2'),
        (None, 'no id', None, 'https://m.example/o'),
        (None, None, None, None),
        (None, None, None, None),
    ],
    'web_media_errors': [
        ('HTTP Error 429', 'rate_limited'),
        ('Too Many Requests', 'rate_limited'),
        ('Sign in to confirm you are no bot', 'authentication_or_block'),
        ('login required after timeout', 'authentication_or_block'),
        ('Connection reset by peer', 'network'),
        ('unsupported url', 'tool_or_source'),
        (None, 'tool_or_source'),
    ],
    'web_media_waits': [
        (None, None, 300),
        (60.0, None, 60),
        (60.5, None, 120),
        (300.0, None, 120),
        (900.0, None, 300),
        (901.0, None, 600),
        (5.0, 0, 1),
        (5.0, 50, 50),
        (5.0, 5000, 600),
        (None, None, 300),
    ],
    'web_accounts': [
        ('A', 'https://a.example/u', 'claimed', 1.0),
        ('B', 'https://b.example/u', 'unknown', 0.4),
        ('E', 'https://e.example', 'unknown', 1.0),
        ('F', 'https://f.example', 'claimed', 1.0),
    ],
    'web_comments': [
        (0, 0, 'a', 'ann', 'one'),
        (1, 1, 'b', 'bob', 'two'),
        (2, 0, 'c', 'cy', 'three'),
    ],
    'web_relaxed_json': [
        (1, '{"a": 1, "b": [1, 2], "c": "x // y, ]"}'),
        (2, '[1]'),
        (3, '{"u": "https://a.example/*x*/"}'),
    ],
    'web_url_list': [
        ('https://a.example/1',),
        ('https://a.example/2',),
        ('https://a.example/3',),
    ],
    'web_mapped_responses': [
        (1, 0, 'A', 'https://a'),
        (1, 1, None, None),
    ],
    'web_discovered': [
        ('https://www.a.example/p', 0),
        ('https://sub.a.example/docs/q', 0),
        ('https://a.example/docs/r', 1),
    ],
    'web_api_pages': [
        (1, 0, '1', '{"n": 1}'),
        (1, 1, '1', '{"n": 2}'),
        (1, 2, 'k2', '{"n": 3}'),
        (2, 0, '1', '{"n": 1}'),
        (2, 1, '1', '{"n": 2}'),
        (3, 0, '1', '{"n": 1}'),
        (3, 1, '1', '{"n": 2}'),
    ],
    'web_templates': [
        (1, '{"l": [null, 5], "n": 3, "q": "spark", "s": "x {n}"}'),
    ],
    'web_unwrapped': [
        ('https://www.google.com/url?q=https%3A%2F%2Fa.example%2Fx%3Fy&sa=U', 'https://a.example/x?y'),
        ('https://r.search.yahoo.com/x/RU=https%3A%2F%2Fb.example%2F/RK=2/RS=z', 'https://b.example/'),
        ('https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9jLmV4YW1wbGUv&x=1', 'https://c.example/'),
        ('https://d.example/url?q=https%3A%2F%2Fe.example', 'https://d.example/url?q=https%3A%2F%2Fe.example'),
        ('https://www.google.com/url?x=1', 'https://www.google.com/url?x=1'),
    ],
    'pages_meta_fields': [
        ('author', 'Bo'),
        ('canonical', 'https://www.a.example/canon'),
        ('description', 'About'),
        ('image', '/i.png'),
        ('lang', 'en'),
        ('published_time', '2024-05-06'),
        ('site_name', 'Site'),
        ('title', 'Page & title'),
    ],
    'pages_json_ld': [
        (0, '{"@type": "Article", "author": {"name": "Ann"}, "headline": "H"}'),
        (1, '{"@type": "Org"}'),
        (2, '{"@type": "Product", "author": [{"name": "Bo"}], "name": "P"}'),
    ],
    'pages_microdata': [
        (0, '{"@type": "Product", "name": "Chair", "offers": {"@type": "Offer", "currency": "EUR", "price": "9.50"}, "url": "/chair"}'),
    ],
    'pages_script_data': [
        ('json-ld', '{"@graph": [{"@type": "Article", "headline": "H", "author": {"name": "Ann"}}, {"@type": "Org"}]}'),
        ('json-ld', '[{"@type": "Product", "name": "P", "author": [{"name": "Bo"}]}]'),
        ('__NEXT_DATA__', '{"props": {"a": [1, 2]}}'),
        ('state', '{"x": "</p>", "y": [1]}'),
        ('cfg', '[1, 2]'),
    ],
    'pages_images': [
        (0, 'https://www.a.example/a.png'),
        (1, 'https://c.example/b.jpg'),
    ],
    'pages_link_kinds': [
        (0, 'https://www.a.example/home', 'Home', 'navigation'),
        (1, 'https://www.a.example/chair', 'x', 'citation'),
        (2, 'https://www.a.example/ref?x=1', 'ref', 'citation'),
        (3, 'https://arxiv.org/abs/1', 'paper', 'external'),
        (4, 'https://www.a.example/imprint', 'Imprint', 'navigation'),
    ],
    'pages_link_report': [
        ('citations', 30, 'https://www.a.example/c29'),
        ('navigation', 20, 'https://www.a.example/n19'),
        ('external', 1, 'https://github.com/x'),
        ('primary_source', None, 'https://github.com/x'),
        ('citations', 2, 'https://www.a.example/ref?x=1'),
        ('navigation', 2, 'https://www.a.example/imprint'),
        ('external', 1, 'https://arxiv.org/abs/1'),
        ('primary_source', None, 'https://arxiv.org/abs/1'),
    ],
    'pages_link_list': [
        ('- [Home](https://www.a.example/home)\n- [x](https://www.a.example/chair)\n- [ref](https://www.a.example/ref?x=1)\n- [paper](https://arxiv.org/abs/1)\n- [Imprint](https://www.a.example/imprint)',),
    ],
    'pages_rich_markdown': [
        ('Home\n\nJS\n\nChair\n\nEUR\n\nx\n\n# Heading one\n\nFirst **bold** [ref](/ref?x=1#f) and [paper](https://arxiv.org/abs/1).\n\nSecond\n\nThird \nline\n\n- one\n- two `x`\n\n```\n  code\n here\n```\n\nImprint',),
    ],
    'pages_sanitised': [
        ('<div>abdf</div>',),
    ],
    'pages_pruned': [
        (1, 'A long paragraph of real text. A long paragraph of real text'),
        (2, 'deep text of a long paragraph. deep text of a long paragraph'),
    ],
    'pages_tree_metrics': [
        (4, 4, 3),
        (401, 248, 401),
        (0, 0, 0),
    ],
    'pages_odd_tables': [
        (1, 'Cap', 'A|B|B', 0, '1|2|3#3'),
        (1, 'Cap', 'A|B|B', 1, '1|4|5#3'),
        (2, '', 'A|B', 0, '1|2#2'),
        (5, 'C', 'A|B||', 0, '1|1|1|1#64'),
    ],
    'pages_schema_records': [
        ('{"by": null, "id": "1", "link": "/1", "price": "9.50", "tags": ["a", "b"], "title": "ONE"}',),
        ('{"by": {"who": "Ann"}, "id": "2", "link": null, "price": "0", "tags": [], "title": "TWO"}',),
    ],
    'pages_schema_checks': [
        (1, True, 'attribute,name,selector,type'),
        (2, False, 'fields must be a list, and not an empty one'),
        (3, False, 'every field needs a name of its own'),
        (4, False, 'a names no attribute'),
        (5, False, 'pattern of a'),
        (6, True, 'attribute,name,selector,type'),
        (7, False, 'keys that carry code are not allowed'),
        (8, False, "unknown type 'odd' of a"),
    ],
    'pages_xpath': [
        ('//li', 0, 'li:a'),
        ('//li', 1, 'li:b'),
        ("//div[@class='card'][2]/h2/text()", 0, 'Two'),
        ("//div[contains(@class,'car')]/@data-id", 0, '1'),
        ("//div[contains(@class,'car')]/@data-id", 1, '2'),
        ("//span[starts-with(text(),'EUR')]", 0, 'span:EUR 9.50'),
        ('//li[last()]', 0, 'li:b'),
        ('//i/../..', 0, 'div:Two Ann'),
        ("//h2[text()='Two']", 0, 'h2:Two'),
    ],
    'pages_selectors': [
        ('div:nth-of-type(1) > h2', '/div[1]/h2', True),
        ('div:nth-of-type(1) > ul > li:nth-of-type(1)', '/div[1]/ul/li[1]', True),
        ('div:nth-of-type(1) > ul > li:nth-of-type(2)', '/div[1]/ul/li[2]', True),
        ('div:nth-of-type(2) > h2', '/div[2]/h2', True),
        ('#here > b', '//*[@id="here"]/b', True),
    ],
    'pages_similar': [
        ('two',),
    ],
    'pages_relocated': [
        ('Buy this chair now', 'div > p:nth-of-type(2)'),
        ('nothing like it at all', None),
    ],
    'pages_narrowed': [
        (0, '<h2> One </h2>'),
        (1, '<span class="price">EUR 9.50</span>'),
        (2, '<h2>Two</h2>'),
    ],
    'pages_minified': [
        ('<div> a b <pre> x  y </pre><b> c </b></div>',),
    ],
    'pages_cleaned': [
        ('title', 'Page & title'),
        ('body', '855'),
        ('links', '6'),
        ('images', '4'),
        ('data', '5'),
    ],
    'pages_references': [
        ('\n\n## References\n\n⟨1⟩ https://www.a.example/ref?x=1#f\n⟨2⟩ https://www.a.example/imprint\n',),
    ],
    'pages_bare_text': [
        ('a b c &',),
        ('',),
        ('x y',),
    ],
    'pages_kinds_by_markup': [
        (1, 'unknown'),
        (2, 'redirect'),
        (3, 'paywall'),
        (4, 'paywall'),
        (5, 'qa'),
        (6, 'forum'),
        (7, 'docs'),
        (8, 'list'),
        (9, 'article'),
        (10, 'unknown'),
        (11, 'unknown'),
    ],
    'pages_block_ladder': [
        (1, 'rate'),
        (2, 'vendor'),
        (3, 'status'),
        (4, 'none'),
        (5, 'marker'),
        (6, 'empty'),
        (7, 'none'),
        (8, 'none'),
        (9, 'none'),
        (10, 'none'),
        (11, 'none'),
    ],
    'pages_quality': [
        (1, 'js_shell_detected'),
        (2, 'js_shell_detected'),
        (3, 'js_shell_detected'),
        (4, ''),
        (5, ''),
        (6, 'geo_redirect_detected'),
        (7, 'bot_challenge_detected'),
        (8, 'http_error_404'),
        (9, 'network_error'),
        (10, ''),
        (11, 'js_shell_detected'),
    ],
    'pages_error_types': [
        ('js_shell_detected: x', 'js_shell'),
        ('AUTH_REQUIRED: y', 'auth_wall'),
        ('not_a_pdf: behind auth', 'auth_wall'),
        ('not_a_pdf: html', ''),
        ('geo_redirect_detected', 'redirect'),
        ('', ''),
        (None, ''),
    ],
    'pages_routes': [
        (1, 'json'),
        (2, 'html'),
        (3, 'pdf'),
        (4, 'auth_required'),
        (5, 'not_a_pdf'),
        (6, 'image'),
        (7, 'listing'),
        (8, 'html'),
        (9, 'html'),
        (10, 'pdf'),
    ],
    'pages_ajax_shells': [
        (1, 2, True),
        (2, 1, False),
        (3, 2, False),
        (4, 2, False),
        (5, 2, True),
        (6, 0, False),
    ],
    'pages_captured': [
        (1, True, False),
        (2, False, True),
        (3, False, False),
        (4, False, False),
        (5, False, False),
        (6, False, True),
        (7, False, False),
        (8, True, True),
    ],
    'pages_payloads': [
        (1, True, False),
        (2, False, False),
        (3, False, True),
        (4, False, False),
        (5, False, False),
        (6, False, False),
    ],
    'pages_fragments': [
        ('p', 1, 'u3', 429, True),
        ('p', 2, 'u2', 623, False),
        ('p', 3, 'u1', 500, False),
        ('p', 4, 'u4', 9, False),
        ('q', 1, 'v1', 420, True),
    ],
    'pages_fragment_scores': [
        (1, 22.36068),
        (2, 194.68775),
        (3, 168.183999),
        (4, 1.133333),
        (5, 25.495098),
        (6, 0.34641),
    ],
    'text_absolute_links': [
        ('[a](https://a.example/x) ![i](https://a.example/d/y.png) [m](mailto:a@b) [h](#t) [w](https://w.example) [sp](https://a.example/d/z)',),
    ],
    'text_pretty_json': [
        (1, '{\n "a": [\n  1,\n  {\n   "b": "ü"\n  }\n ]\n}'),
        (2, 'no json'),
        (3, '[]'),
    ],
    'text_replies': [
        (1, '[{"a": 1, "b": ["x"]}]'),
        (2, '[{"a": "x", "b": null}]'),
        (3, None),
        (4, None),
        (5, None),
    ],
    'text_cited': [
        (1, 'See one⟨1⟩ and two⟨2⟩, again one⟨1⟩ ![img⟨3⟩]', '\n\n## References\n\n⟨1⟩ https://a.example/a: Title - one\n⟨2⟩ https://b.example/x: two\n⟨3⟩ https://a.example/i.png: img\n'),
        (2, 'no links', ''),
        (3, '', ''),
    ],
    'text_clean_values': [
        (1, 'abcd'),
        (2, 'tab\tline\nret\rok'),
        (3, ''),
    ],
    'text_ratios': [
        (1, 0.75),
        (2, 1.0),
        (3, 1.0),
        (4, 0.0),
    ],
    'text_without_noscript': [
        (1, 'a turn it on b&amp;c', 'a b&amp;c'),
    ],
    'text_toc_ends': [
        (0, 8),
        (1, 4),
        (2, 8),
        (3, 9),
        (4, None),
        (5, 12),
    ],
    'text_retry_after': [
        ('120', 120.0),
        ('0', 0.0),
        ('-5', 0.0),
        ('Mon, 01 Jan 2024 00:01:30 GMT', 90.0),
        ('Sun, 31 Dec 2023 00:00:00 GMT', 0.0),
        ('soon', None),
        (None, None),
    ],
    'text_dates': [
        ('2024-01-31T10:00:00Z', '2024-01-31', '2024-01-31T10:00:00Z'),
        ('20240131', '2024-01-31', '2024-01-31'),
        ('2024/01/31', '2024-01-31', '2024/01/31'),
        ('January 31, 2024', '2024-01-31', 'January 31, 2024'),
        ('Jan 31, 2024', '2024-01-31', 'Jan 31, 2024'),
        ('31 January 2024', '2024-01-31', '31 January 2024'),
        ('31 Jan 2024', '2024-01-31', '31 Jan 2024'),
        ('2024-13-01', None, '2024-13-01'),
        ('D:20240131120000Z', '2024-01-31', '2024-01-31'),
        ('yesterday', None, 'yesterday'),
        ('', None, ''),
        (None, None, ''),
    ],
    'text_page_specs': [
        ('', '1,2,3,4,5,6,7,8,9,10'),
        ('1-3,5', '1,2,3,5'),
        ('5,1-3,2', '1,2,3,5'),
        ('9-12', '9,10'),
        ('3-1', '1,2,3'),
        ('x,2', '2'),
        ('0', ''),
    ],
    'text_within_bounds': [
        (1, 5.0),
        (2, 0.0),
        (3, 100.0),
        (4, 7.0),
        (5, 7.0),
        (6, 7.0),
        (7, 7.0),
    ],
    'text_redacted_json': [
        (1, '{"apiKey": "[REDACTED]", "auth": "[REDACTED]", "urls": ["https://a.example/?token=%5BREDACTED%5D&x=2"], "user": {"name": "n", "password": "[REDACTED]"}}'),
        (2, 'plain https://a.example/'),
        (3, None),
    ],
    'text_bounded_json': [
        (1, 42, False),
        (2, 515, True),
    ],
    'text_packed_chunks': [
        (0, 'One two three. Four five six seven. Eight nine. Ten.'),
        (1, 'w0 w1 w2 w3 w4 w5 w6 w7 w8 w9'),
        (2, 'w10 w11 w12 w13 w14 w15 w16 w17 w18 w19'),
        (3, 'w20 w21 w22.'),
        (4, 'End here.'),
    ],
    'text_collapsed_lines': [
        (0, 'Home'),
        (1, 'About'),
        (2, 'Home'),
        (3, 'About'),
        (34, 'Link 0'),
        (35, 'Link 1'),
        (36, 'Link 2'),
        (37, 'Link 3'),
        (38, 'Link 4'),
        (39, '[7 similar links collapsed]'),
        (41, '[12 repeated nav controls collapsed]'),
    ],
    'text_joined_hyphens': [
        (1, 'something new well- Known two words'),
        (2, ''),
        (3, 'a - b'),
    ],
    'pdf_font_sizes': [
        (1, 10.0, 10.0),
        (2, 10.5, 9.0),
        (3, 8.0, 8.0),
    ],
    'url_unsafe_reasons': [
        ('https://a.example/x', None),
        ('http://127.0.0.1/', 'private'),
        ('http://0x7f.1/', 'private'),
        ('http://2130706433/', 'private'),
        ('http://[::1]/', 'private'),
        ('http://[::ffff:10.0.0.1]/', 'private'),
        ('http://192.168.0.9:8080/', 'private'),
        ('http://169.254.169.254/latest', 'metadata'),
        ('http://metadata.google.internal/', 'metadata'),
        ('ftp://a.example/', 'scheme'),
        ('https://u:p@a.example/', 'credentials'),
        ('http://localhost./', 'private'),
        ('https://x.internal/', 'private'),
        ('https://1.2.3.4.nip.io/', 'rebinding'),
        ('https://8.8.8.8/', None),
        ('https://a.example:99999/', 'malformed'),
        ('https://a.example/\nx', 'malformed'),
        ('', 'malformed'),
        (None, 'malformed'),
    ],
    'url_platforms': [
        ('https://www.instagram.com/p/x', 'instagram'),
        ('https://vm.tiktok.com/x', 'tiktok'),
        ('https://youtu.be/x', ''),
        ('https://a.example/', ''),
        ('', ''),
    ],
    'url_capped_score': [
        (1, True),
        (2, False),
        (3, False),
    ],
    'search_query_map': [
        ('spark vs flink', 'brave', 'comparison', None, 'spark vs flink'),
        ('spark vs flink', 'google', 'comparison', None, 'spark vs flink'),
        ('research paper on memory', 'google', 'research', 'semantic_scholar', 'research paper on memory arxiv benchmark results'),
        ('research paper on memory', 'yahoo', 'research', 'semantic_scholar', 'research paper on memory'),
        ('latest news on spark', 'qwant', 'news', 'hackernews', 'latest news on spark'),
        ('plain words', 'google', 'general', None, 'plain words'),
    ],
    'search_quorum_rule': [
        (1, '00:00:05'),
        (2, '00:00:04'),
        (4, '00:00:09'),
    ],
    'state_key_order': [
        (0, 0),
        (1, 1),
        (2, 2),
        (3, 0),
        (4, 2),
        (5, -1),
        (6, 1),
        (7, 2),
        (8, 0),
    ],
    'state_route_order': [
        (0, 0, 0),
        (1, 1, 1),
        (2, 0, 0),
        (3, 0, 0),
        (4, 0, -1),
        (5, 0, -1),
        (6, 1, 1),
        (7, 0, 0),
        (8, 1, 1),
    ],
    'state_policy_reads': [
        (0, True),
        (1, False),
        (2, True),
        (3, False),
        (4, False),
        (5, True),
        (6, True),
        (7, False),
        (8, True),
    ],
    'state_hits_in_time': [
        (1, 1),
        (2, 2),
        (3, None),
        (4, None),
        (5, None),
        (6, None),
        (7, 4),
    ],
    'social_aliases': [
        (1, 'instagram:id:A'),
        (2, 'instagram:id:A instagram:url:https://www.instagram.com/p/A'),
        (3, 'id:B url:https://b.example/x'),
        (4, 'url:https://b.example/x'),
        (5, 'tiktok:id:A'),
        (6, ''),
        (7, ''),
        (8, 'instagram:id:S'),
    ],
    'social_unseen': [
        (6,),
        (7,),
        (3,),
        (1,),
        (5,),
    ],
    'social_grid': [
        (None, 'https://www.instagram.com/x', 'odd', None, None, None, None),
        ('A', 'https://www.instagram.com/reel/A/', 'p', '99', '5', '7', 'ga'),
        ('B', 'https://www.instagram.com/p/B/', None, None, '2.5K', '3', None),
        ('C', 'https://www.instagram.com/p/C/', 'only', None, '1', None, 'pc'),
        ('D', 'https://www.instagram.com/reel/D/', None, None, None, None, None),
    ],
    'social_likes': [
        (1, 0, 'first', None),
        (1, 2, 'second', 1200),
        (1, 6, 'third', 3),
        (1, 7, 'fourth', None),
        (2, 0, 'other', None),
    ],
    'crawl_best_first': [
        (2, 'https://a.example/', 0),
        (2, 'https://a.example/docs', 1),
        (100, 'https://a.example/', 0),
        (100, 'https://a.example/docs', 1),
        (100, 'https://a.example/login', 1),
        (100, 'https://a.example/docs/2', 2),
        (100, 'https://a.example/deep', 3),
    ],
    'plan_pipeline': [
        (0, 'good', True, 3),
        (1, 'top', True, 2),
        (2, 'bad', False, None),
        (3, 'after', False, None),
    ],
    'search_selected': [
        ('https://a.example/1',),
        ('https://a.example/4',),
    ],
    'search_rerank_pool': [
        (3, 12),
        (10, 20),
    ],
}
