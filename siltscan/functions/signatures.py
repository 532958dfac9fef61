"""The built-in rules that results must agree on.

Each rule is (code, name, severity, patterns); a pattern is (RE2 expression, ignores case, gates). Every gate is a
'|'-list of lower-case literals, one of which any match contains. Rules without patterns are analyzers, archive or name rules.
"""

from __future__ import annotations

#: Fixed values, in the order in which rules report.
RULES: tuple[tuple[str, str, str, tuple[tuple[str, bool, tuple[str, ...]], ...]], ...] = (
    ('WS001', 'China Chopper webshell', 'critical', (
        (r'@(?i:eval)\s*\(\s*\$_POST\s*\[', False, ('_post', 'eval')),
        (r'@?(?i:assert)\s*\(\s*\$_POST\s*\[', False, ('assert', '_post')),
    )),
    ('WS002', 'Z0 parameter backdoor', 'critical', (
        ('\\$_REQUEST\\s*\\[\\s*[\'"]z0[\'"]\\s*\\]', False, ('_request',)),
        ('\\$_POST\\s*\\[\\s*[\'"]z0[\'"]\\s*\\]', False, ('_post',)),
    )),
    ('WS003', 'Weevely webshell', 'critical', (
        (r'\$\w+\s*=\s*(?i:str_replace)\s*\([^;]+;\s*\$\w+\s*\(\s*\$\w+\s*\(\s*\$_', False, ('str_replace',)),
    )),
    ('WS004', 'WSO webshell', 'critical', (
        (r'WSO\s+\d+\.\d+', False, ('wso',)),
        (r'Web\s*Shell\s*by\s*oRb', False, ('shell',)),
    )),
    ('WS005', 'r57/c99 shell', 'critical', (
        (r'r57shell|c99shell|c99mad', False, ('r57shell|c99shell|c99mad',)),
        (r'r57\s+shell|c99\s+shell', False, ('r57|c99',)),
    )),
    ('WS006', 'FilesMan webshell', 'critical', (
        (r'(?:FilesMan|Fil3sM4n)\b', False, ('filesman|fil3sm4n',)),
    )),
    ('WS007', 'b374k webshell', 'critical', (
        (r'b374k\s*shell|b374k\s+\d+\.\d+', False, ('b374k',)),
    )),
    ('WS008', 'Malicious upload handler', 'high', (
        (r'(?i:move_uploaded_file)\s*\([^,]+,\s*\$_(GET|POST|REQUEST)', False, ('move_uploaded_file', '$_get|$_post|$_request')),
    )),
    ('WS009', 'Encoded webshell loader', 'critical', (
        (r'(?i:eval)\s*\(\s*(?i:gzinflate)\s*\(\s*(?i:base64_decode)', False, ('gzinflate', 'eval')),
        (r'(?i:eval)\s*\(\s*(?i:gzuncompress)\s*\(\s*(?i:base64_decode)', False, ('gzuncompress', 'eval')),
        (r'(?i:eval)\s*\(\s*(?i:str_rot13)\s*\(\s*(?i:base64_decode)', False, ('str_rot13', 'eval')),
    )),
    ('WS010', '404 cloak on a request parameter', 'high', ()),
    ('WS011', 'Mailer behind a hardcoded password', 'critical', ()),
    ('BD001', 'Hidden admin creation', 'critical', (
        (r'(?i:wp_insert_user)\s*\([^)]*user_login[^)]*administrator', False, ('wp_insert_user', 'administrator', 'user_login')),
        (r'INSERT\s+INTO\s+\S*users\S*[^;]*admin', False, ('insert', 'admin', 'users')),
    )),
    ('BD002', 'Cron-based persistence', 'high', (
        (r'(?i:wp_schedule_event)\s*\(\s*[^,]{0,200},\s*[^,]{0,200},\s*[^)]{0,200}\$_(GET|POST|REQUEST|COOKIE)', False, ('wp_schedule_event', '$_get|$_post|$_request|$_cookie')),
    )),
    ('BD003', 'Plugin/theme backdoor installer', 'critical', (
        (r'(?i:file_put_contents)\s*\([^,]*wp-content/(plugins|themes)[^,]*,\s*(?i:base64_decode)', False, ('file_put_contents', 'wp-content/')),
    )),
    ('BD004', 'Config file reader', 'high', (
        (r'(?i:file_get_contents)\s*\([^)]*wp-config\.php', False, ('file_get_contents', 'wp-config')),
        (r'(?i:file_get_contents)\s*\([^)]*configuration\.php', False, ('file_get_contents', 'configuration')),
    )),
    ('BD005', 'Socket-based backdoor', 'critical', (
        (r'(?i:fsockopen)\s*\([^)]+\)\s*.*?(?i:fwrite)\s*\([^)]*\$_(GET|POST|REQUEST)', False, ('fsockopen', 'fwrite', '$_get|$_post|$_request')),
        (r'(?i:socket_create)\s*\([^)]+\).*?\b((?i:shell_exec)|(?i:exec)|(?i:system)|(?i:passthru)|(?i:popen))\s*\(', False, ('socket_create',)),
        (r'socket_write\s*\([^,]+,\s*\$_(GET|POST|REQUEST)', False, ('socket_write', '$_get|$_post|$_request')),
    )),
    ('BD006', 'Reverse shell pattern', 'critical', (
        (r'bash\s+-i\s+>&\s*/dev/tcp/', False, ('/dev/tcp/', 'bash')),
        (r'/bin/sh\s*\|\s*nc\s+', False, ('/bin/sh',)),
    )),
    ('BD007', 'Encoded reverse shell', 'critical', (
        (r'(?i:base64_decode)\s*\([^)]*\).{0,200}?((?i:fsockopen)|(?i:socket_create)|(?i:pfsockopen))', False, ('base64_decode',)),
    )),
    ('BD008', 'htaccess backdoor', 'high', (
        ('(?i:file_put_contents)\\s*\\(\\s*[\'"][^\'"]*\\.htaccess', False, ('file_put_contents', 'htaccess')),
    )),
    ('BD009', 'Password reset backdoor', 'critical', (
        (r'(?i:wp_set_password)\s*\([^)]*\$_(GET|POST|REQUEST)', False, ('wp_set_password', '$_get|$_post|$_request')),
    )),
    ('BD011', 'Hardcoded password hash', 'critical', (
        ('(?i:sha1)\\s*\\([^)]+\\)\\s*==\\s*[\'"][0-9a-fA-F]{40}[\'"]', False, ('sha1',)),
        ('(?i:md5)\\s*\\([^)]+\\)\\s*==\\s*[\'"][0-9a-fA-F]{32}[\'"]', False, ('md5',)),
        ('\\$\\w+\\s*==\\s*[\'"][0-9a-fA-F]{40}[\'"]', False, ()),
        ('\\$\\w+\\s*==\\s*[\'"][0-9a-fA-F]{32}[\'"]', False, ()),
    )),
    ('BD012', 'File write with user input', 'critical', (
        (r'(?i:file_put_contents)\s*\([^,]+,\s*\$_(GET|POST|REQUEST)\s*\[', False, ('file_put_contents', '$_get|$_post|$_request')),
    )),
    ('BD013', 'Embedded private key', 'critical', (
        (r'-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----\s*MII[A-Za-z0-9+/]{50,}', False, ('-----begin', 'key-----', 'private')),
    )),
    ('BD014', 'Timestamp manipulation', 'high', (
        (r'time\s*\(\s*\)\s*-\s*\(?mt_rand', False, ('mt_rand', 'time')),
        (r'filectime\s*\(\s*\$\w+\s*\)[^;]*;[^}]*(?i:touch)\s*\(', False, ('filectime', 'touch')),
    )),
    ('BD015', 'HTTP header command channel', 'critical', (
        ('\\$_SERVER\\s*\\[\\s*[\'"]HTTP_[A-Z][\'"]', False, ('_server', 'http_')),
        (r'(?i:openssl_private_decrypt)\s*\([^,]+\$_SERVER', False, ('openssl_private_decrypt', '_server')),
    )),
    ('BD016', 'Base64 include backdoor', 'critical', (
        (r'@\s*((?i:include)|(?i:include_once)|(?i:require)|(?i:require_once))\s*\(?\s*(?i:base64_decode)\s*\(', True, ('base64_decode',)),
        (r'((?i:include)|(?i:include_once)|(?i:require)|(?i:require_once))\s*\(?\s*(?i:base64_decode)\s*\(', True, ('include|include_once|require|require_once', 'base64_decode')),
    )),
    ('BD017', 'htaccess backdoor whitelist', 'critical', (
        (r'<FilesMatch[^>]*php[^>]*>\s*Order\s[^<]*Deny\s+from\s+all[^<]*</FilesMatch>\s*<FilesMatch[^>]*>\s*Order\s[^<]*Allow\s+from\s+all', True, ('</filesmatch>', '<filesmatch', 'allow')),
        (r'<FilesMatch[^>]*(wp-l0gin|wp-the1me|wp-scr1pts|lock360|sh3ll|c99|r57|b374k|alfa|fox|mini|wso|mari)[^>]*>', True, ('<filesmatch',)),
    )),
    ('BD018', 'Quarantine-reversing rename', 'critical', (
        (r'rename\s*\(\s*[^,)]*\.(suspected|quarantine|infected|virus|malware|bak_av)[^,)]*,\s*[^)]*\.(php|phtml|php5|inc|module|cgi|pl|py|sh)\b', True, ('rename', 'suspected|quarantine|infected|virus|malware|bak_av')),
    )),
    ('BD019', 'htaccess runs a data file as a script', 'critical', (
        ('(?m)^[ \\t]*(?:AddType|AddHandler)[ \\t]+["\']?[^\\s"\']*(?:php|proxy:[^\\s"\']*fcgi:|cgi-script|fcgid-script)(?:\\\\\\r?\\n|[^\\r\\n])*', True, ('addtype|addhandler', 'php|fcgi:|cgi-script|fcgid-script')),
        ('(?m)^[ \\t]*(?:SetHandler|ForceType)[ \\t]+["\']?[^\\s"\']*(?:php|proxy:[^\\s"\']*fcgi:|cgi-script|fcgid-script)[^\\r\\n]*', True, ('sethandler|forcetype', 'php|fcgi:|cgi-script|fcgid-script')),
    )),
    ('BD020', 'htaccess runs HTML as a script', 'medium', (
        ('(?m)^[ \\t]*(?:AddType|AddHandler)[ \\t]+["\']?[^\\s"\']*(?:php|proxy:[^\\s"\']*fcgi:|cgi-script|fcgid-script)(?:\\\\\\r?\\n|[^\\r\\n])*', True, ('addtype|addhandler', 'php|fcgi:|cgi-script|fcgid-script')),
        ('(?m)^[ \\t]*(?:SetHandler|ForceType)[ \\t]+["\']?[^\\s"\']*(?:php|proxy:[^\\s"\']*fcgi:|cgi-script|fcgid-script)[^\\r\\n]*', True, ('sethandler|forcetype', 'php|fcgi:|cgi-script|fcgid-script')),
    )),
    ('OBF001', 'Hex-encoded variable names', 'high', (
        ('\\$GLOBALS\\s*\\[\\s*[\'"]\\\\x[0-9a-fA-F]{2}', False, ('globals',)),
    )),
    ('OBF002', 'chr() string building', 'medium', (
        (r'(?i:chr)\s*\(\s*\d+\s*\)\s*\.\s*(?i:chr)\s*\(\s*\d+\s*\)\s*\.\s*(?i:chr)\s*\(\s*\d+\s*\)\s*\.\s*(?i:chr)', False, ('chr',)),
    )),
    ('OBF003', 'pack() hex obfuscation', 'high', (
        ('(?i:pack)\\s*\\(\\s*[\'"]H\\*[\'"]\\s*,\\s*[\'"][0-9a-fA-F]{20,}[\'"]', False, ('pack',)),
    )),
    ('OBF004', 'Long base64 decode', 'medium', (
        ('(?i:base64_decode)\\s*\\(\\s*[\'"][A-Za-z0-9+/]{500,}={0,2}[\'"]', False, ('base64_decode',)),
        ('\\$\\w+\\s*=\\s*(?i:base64_decode)\\s*\\(\\s*[\'"][A-Za-z0-9+/]{300,}', False, ('base64_decode',)),
    )),
    ('OBF005', 'strrev() function hiding', 'critical', (
        ('(?i:strrev)\\s*\\([^)]*["\'][^"\']*["\']\\s*\\.\\s*["\'][^"\']*["\'][^)]*\\)', False, ('strrev',)),
    )),
    ('OBF006', 'Concatenated function name', 'medium', (
        ('\\$\\w+\\s*=\\s*[\'"][a-z]{1,4}[\'"]\\s*\\.\\s*[\'"][a-z]{1,4}[\'"]\\s*\\.\\s*[\'"][a-z]{1,4}[\'"]', False, ()),
    )),
    ('OBF007', 'Array-based function call', 'high', (
        (r'\$\w+\[\d+\]\s*\(\s*\$\w+\[\d+\]', False, ()),
    )),
    ('OBF008', 'str_replace() obfuscation', 'high', (
        ('(?i:str_replace)\\s*\\(\\s*[\'"][^\'"]+[\'"]\\s*,\\s*[\'"][\'"]?\\s*,\\s*[\'"](e|ba|as|ev|sy|ex)[^\'"]+[\'"]', False, ('str_replace',)),
    )),
    ('OBF009', 'Nested base64 decoding', 'high', (
        (r'(?i:base64_decode)\s*\(\s*(?i:base64_decode)', False, ('base64_decode',)),
    )),
    ('OBF010', 'Compressed base64 payload', 'high', (
        (r'(?i:gzuncompress)\s*\(\s*(?i:base64_decode)', False, ('gzuncompress',)),
    )),
    ('OBF011', 'URL-encoded base64 payload', 'medium', (
        (r'(?i:rawurldecode)\s*\(\s*(?i:base64_decode)', False, ('rawurldecode',)),
    )),
    ('OBF012', 'Variable variable function call', 'high', (
        (r'\$\{\s*\$\w+\s*\}\s*\(', False, ('${',)),
    )),
    ('OBF013', 'extract() with user input', 'high', (
        (r'(?i:extract)\s*\(\s*\$_(GET|POST|REQUEST|COOKIE)', False, ('extract', '$_get|$_post|$_request|$_cookie')),
    )),
    ('OBF014', 'ROT13 encoded payload', 'medium', (
        ('(?i:str_rot13)\\s*\\(\\s*[\'"][^\'"]{20,}[\'"]', False, ('str_rot13',)),
    )),
    ('OBF015', 'Goto obfuscation', 'critical', (
        (r'goto\s+[a-zA-Z0-9]*[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*;\s*[a-zA-Z0-9]*[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*:', False, ('goto',)),
    )),
    ('OBF016', 'Octal-encoded strings', 'high', (
        (r'(\\[0-7]{2,3}){8,}', False, ()),
    )),
    ('OBF017', 'Variable function call', 'critical', (
        ('\\$\\w+\\s*=\\s*\\w+\\s*\\(\\s*["\'][^"\']+["\']\\s*\\)\\s*;\\s*return\\s+\\$\\w+\\s*\\(', False, ('return',)),
    )),
    ('OBF020', 'Double decode obfuscation', 'high', (
        (r'(?i:str_rot13)\s*\(\s*(?i:urldecode)\s*\(', False, ('urldecode', 'str_rot13')),
        (r'(?i:urldecode)\s*\(\s*(?i:str_rot13)\s*\(', False, ('urldecode', 'str_rot13')),
        (r'(?i:base64_decode)\s*\(\s*(?i:str_rot13)\s*\(', False, ('base64_decode', 'str_rot13')),
        (r'(?i:str_rot13)\s*\(\s*(?i:base64_decode)\s*\(', False, ('base64_decode', 'str_rot13')),
    )),
    ('OBF021', 'Double variable function call', 'critical', (
        (r'\$[a-z][0-9]?\s*\(\s*\$[a-z][0-9]?\s*\)', False, ()),
    )),
    ('OBF018', 'Custom decryption function', 'critical', (
        (r'function\s+\w+\s*\([^)]*\)\s*\{[^}]*(?i:base64_decode)[^}]*while[^}]*(?i:chr)[^}]*\^', False, ('base64_decode', 'function', 'while')),
        (r'function\s+\w+\s*\([^)]*\)\s*\{[^}]*(?i:base64_decode)[^}]*for[^}]*(?i:chr)[^}]*\^', False, ('base64_decode', 'function')),
    )),
    ('OBF019', 'Arithmetic obfuscation', 'medium', (
        (r'\(-?\d{4,}\s*[+\-]\s*\(?\-?\d{3,}\)?\s*[+\-]\s*\(?\-?\d{3,}\)?', False, ()),
    )),
    ('OBF022', 'Hex variable variable', 'critical', (
        ('\\$\\{\\s*(?:"(?:\\\\x[0-9a-fA-F]{2})+"|\'(?:\\\\x[0-9a-fA-F]{2})+\')\\s*\\}', False, ()),
    )),
    ('OBF023', 'GLOBALS array concatenation', 'critical', (
        (r'\$GLOBALS\s*\[[^]]+\]\s*\[\s*\d+\s*\]\s*\.\s*\$GLOBALS\s*\[[^]]+\]\s*\[\s*\d+\s*\]\s*\.\s*\$GLOBALS', False, ('globals',)),
    )),
    ('OBF024', 'Runtime-assembled identifier', 'critical', ()),
    ('OBF025', 'Split sensitive function name', 'medium', ()),
    ('OBF036', 'Binary payload in text file', 'high', ()),
    ('OBF037', 'Mixed octal/hex escaped string', 'high', ()),
    ('OBF029', 'Chunked payload accumulation', 'critical', ()),
    ('OBF038', 'Generated noise comments', 'high', ()),
    ('OBF039', 'Substitution cipher decoder', 'critical', ()),
    ('OBF040', 'Split URL scheme', 'high', ()),
    ('OBF041', 'Forged image signature', 'high', ()),
    ('OBF042', 'Shuffled base64 alphabet', 'critical', ()),
    ('PHI001', 'Brand phishing form', 'critical', (
        ('<form[^>]*action\\s*=\\s*[\'"][^\'"]*[\'"][^>]*>.{0,1000}?(?i:paypal|apple|microsoft|google|facebook|instagram|netflix)[^<]{0,200}(?i:password)', False, ('password', 'action', '<form')),
    )),
    ('PHI002', 'Password email exfiltration', 'critical', (
        ('(?i:mail)\\s*\\([^)]+\\$_(POST|GET|REQUEST)\\s*\\[\\s*[\'"]pass(word)?[\'"]', False, ('pass', 'mail')),
    )),
    ('PHI003', 'Cookie stealing', 'critical', (
        (r'document\.cookie.*?(location|window\.open|fetch|XMLHttpRequest)', False, ('document', 'cookie')),
    )),
    ('PHI004', 'Fake login page', 'high', (
        (r'<title>[^<]*(login|signin|sign in|verify|update|confirm)[^<]*</title>.*?<form.*?password', False, ('password', '</title>', '<title>')),
    )),
    ('PHI005', 'curl data exfiltration', 'high', (
        (r'curl\s+[^;]*-d\s+[^;]*\$_(POST|GET|REQUEST)\s*\[', False, ('curl',)),
    )),
    ('PHI006', 'Session hijacking', 'high', (
        (r'session_id\s*\(\s*\$_(GET|POST|REQUEST)', False, ('session_id', '$_get|$_post|$_request')),
    )),
    ('PHI007', 'Credit card harvesting', 'critical', (
        (r'(?i:preg_match)\s*\([^)]*\d{13,16}[^)]*,\s*\$_(POST|GET|REQUEST)', False, ('preg_match',)),
    )),
    ('PHI008', 'Fake security warning', 'medium', (
        (r'(your\s+account\s+(has\s+been|is)\s+(compromised|hacked|suspended))|(verify\s+your\s+identity)', False, ()),
    )),
    ('PHI009', 'Form data mailed to a hardcoded address', 'critical', ()),
    ('EXP001', 'SQL Injection', 'critical', (
        ('(?i:mysql_query)\\s*\\(\\s*[\'"][^\'"]*\\$_(GET|POST|REQUEST)', False, ('mysql_query', '$_get|$_post|$_request')),
        ('\\$\\w+->query\\s*\\(\\s*[\'"][^\'"]*\\$_(GET|POST|REQUEST)', False, ('->query', '$_get|$_post|$_request')),
    )),
    ('EXP002', 'Path traversal', 'high', (
        (r'((?i:include)|(?i:require)|(?i:fopen)|(?i:file_get_contents)|(?i:readfile))\s*\(\s*\$_(GET|POST|REQUEST)\s*\[', False, ('include|require|fopen|file_get_contents|readfile', '$_get|$_post|$_request')),
    )),
    ('EXP003', 'Local File Inclusion', 'critical', (
        (r'((?i:include)|(?i:require))(_once)?\s*\(\s*\$\w+\s*\.\s*\$_(GET|POST|REQUEST)', False, ('include|require', '$_get|$_post|$_request')),
    )),
    ('EXP004', 'XXE injection', 'high', (
        (r'simplexml_load_string\s*\(\s*\$_(GET|POST|REQUEST)', False, ('simplexml_load_string', '$_get|$_post|$_request')),
        (r'\$\w+->(?i:loadXML)\s*\(\s*\$_(GET|POST|REQUEST)', False, ('loadxml', '$_get|$_post|$_request')),
    )),
    ('EXP005', 'SSRF vulnerability', 'high', (
        (r'(?i:curl_setopt)\s*\([^,]+,\s*CURLOPT_URL\s*,\s*\$_(GET|POST|REQUEST)', False, ('curlopt_url', 'curl_setopt', '$_get|$_post|$_request')),
        (r'(?i:file_get_contents)\s*\(\s*\$_(GET|POST|REQUEST)\s*\[', False, ('file_get_contents', '$_get|$_post|$_request')),
    )),
    ('EXP006', 'PHP Object Injection', 'critical', (
        (r'(?i:unserialize)\s*\(\s*\$_(GET|POST|REQUEST|COOKIE)', False, ('unserialize', '$_get|$_post|$_request|$_cookie')),
    )),
    ('EXP007', 'Arbitrary file deletion', 'high', (
        (r'(?i:unlink)\s*\(\s*\$_(GET|POST|REQUEST)\s*\[', False, ('unlink', '$_get|$_post|$_request')),
    )),
    ('EXP008', 'Header injection', 'high', (
        ('header\\s*\\(\\s*[\'"]Location:\\s*\\$_(GET|POST|REQUEST)', False, ('location:', 'header', '$_get|$_post|$_request')),
    )),
    ('EXP009', 'Embedded shell payload', 'critical', (
        (r'(?:^|[^A-Za-z0-9_$>:])((?i:system)|(?i:passthru)|(?i:shell_exec)|(?i:exec)|(?i:popen))\s*\(\s*\\\$_(GET|POST|REQUEST|COOKIE)', False, ('system|passthru|shell_exec|exec|popen', '$_get|$_post|$_request|$_cookie')),
        ('[\'"]<\\?php[^\'"]{0,80}[^A-Za-z0-9_$>:]((?i:system)|(?i:passthru)|(?i:shell_exec)|(?i:exec)|(?i:popen))\\s*\\(\\s*\\$_(GET|POST|REQUEST|COOKIE)', False, ('<?php', 'system|passthru|shell_exec|exec|popen', '$_get|$_post|$_request|$_cookie')),
    )),
    ('EXP010', 'Exploit tool', 'critical', (
        ('(?i:fsockopen)\\s*\\([^)]+\\).*?(?i:fputs)?\\s*\\([^,]+,\\s*[\'"][A-Z]+\\s+/', False, ('fsockopen',)),
    )),
    ('DRP001', 'Remote code loader', 'critical', (
        ('(?i:file_get_contents)\\s*\\(\\s*[\'"]https?://[^\'"]+[\'"]\\s*\\).*?(?i:eval)', False, ('file_get_contents', 'http')),
    )),
    ('DRP002', 'Download and execute', 'critical', (
        (r'(curl|wget)\s+[^;|&]+\s*\|\s*(php|sh|bash)', False, ('curl|wget',)),
    )),
    ('DRP003', 'Self-replicating code', 'high', (
        ('(?i:file_put_contents)\\s*\\(\\s*\\$_SERVER\\s*\\[\\s*[\'"]SCRIPT_FILENAME[\'"]', False, ('file_put_contents', 'script_filename', '_server')),
    )),
    ('DRP004', 'Web root dropper', 'critical', (
        ('(?i:file_put_contents)\\s*\\(\\s*\\$_SERVER\\s*\\[\\s*[\'"]DOCUMENT_ROOT[\'"]\\s*\\]\\s*\\.\\s*[\'"][^\'"]+\\.php[\'"]', False, ('file_put_contents', 'document_root', '_server')),
    )),
    ('DRP005', 'Remote file include', 'critical', (
        ('((?i:include)|(?i:require))(_once)?\\s*\\(\\s*[\'"]https?://', False, ('include|require', 'http')),
    )),
    ('DRP006', 'Base64 payload dropper', 'critical', (
        ('(?i:file_put_contents)\\s*\\([^,]+,\\s*(?i:base64_decode)\\s*\\(\\s*[\'"][A-Za-z0-9+/]{100,}', False, ('file_put_contents', 'base64_decode')),
    )),
    ('DRP007', 'Base64 payload staging', 'critical', (
        ('\\$\\w+\\s*=\\s*(?i:base64_decode)\\s*\\(\\s*[\'"][A-Za-z0-9+/]{500,}', False, ('base64_decode',)),
    )),
    ('DRP008', 'Archive dropper', 'high', (
        ('(?i:file_put_contents)\\s*\\(\\s*[\'"][^\'"]*\\.(zip|tar|gz|rar|7z)[\'"]', False, ('file_put_contents',)),
    )),
    ('DRP009', 'Dropper function', 'high', (
        (r'function\s+((?i:copy)|write|save|drop|create)file\s*\(', False, ('function', 'file')),
    )),
    ('DRP010', 'Document root file drop', 'critical', (
        ('((?i:file_put_contents)|(?i:fopen)|(?i:fwrite)|(?i:copy)|(?i:rename)|(?i:move_uploaded_file))\\s*\\([^;]{0,200}\\$_SERVER\\s*\\[\\s*[\'"]DOCUMENT_ROOT[\'"]\\s*\\]\\s*\\.\\s*[\'"]/[\'"]\\s*\\.\\s*\\$', False, ('document_root', '_server', 'file_put_contents|fopen|fwrite|copy|rename|move_uploaded_file')),
        (r'(?i:file_put_contents)\s*\([^,]*DOCUMENT_ROOT[^,]*index', False, ('file_put_contents', 'document_root', 'index')),
    )),
    ('RCE001', 'eval base64 decode', 'critical', (
        (r'(?i:eval)(?:\s|/\*(?:[^*]|\*+[^*/])*\*+/)*\(\s*(?i:base64_decode)(?:\s|/\*(?:[^*]|\*+[^*/])*\*+/)*\(', False, ('base64_decode', 'eval')),
    )),
    ('RCE002', 'eval gzinflate', 'critical', (
        (r'(?i:eval)(?:\s|/\*(?:[^*]|\*+[^*/])*\*+/)*\(\s*(?i:gzinflate)(?:\s|/\*(?:[^*]|\*+[^*/])*\*+/)*\(', False, ('gzinflate', 'eval')),
    )),
    ('RCE003', 'Dynamic function with user input', 'critical', (
        (r'[\n;{(\s]\$\w+\s*\(\s*\$_(GET|POST|REQUEST|COOKIE)\s*\[', False, ('$_get|$_post|$_request|$_cookie',)),
    )),
    ('RCE004', 'eval with user input', 'critical', (
        (r'(?i:eval)(?:\s|/\*(?:[^*]|\*+[^*/])*\*+/)*\(\s*\$_(GET|POST|REQUEST|COOKIE)\s*\[', False, ('eval', '$_get|$_post|$_request|$_cookie')),
    )),
    ('RCE005', 'assert with user input', 'critical', (
        (r'(?i:assert)(?:\s|/\*(?:[^*]|\*+[^*/])*\*+/)*\(\s*\$_(GET|POST|REQUEST|COOKIE)\s*\[', False, ('assert', '$_get|$_post|$_request|$_cookie')),
    )),
    ('RCE006', 'preg_replace code execution', 'critical', (
        ('(?i:preg_replace)\\s*\\(\\s*[\'"]/[^/]+/[a-zA-Z]*e[a-zA-Z]*[\'"]', False, ('preg_replace',)),
        ('(?i:preg_replace)\\s*\\(\\s*[\'"]/[^/]+/[^\'"]*\\\\x65[^\'"]*[\'"]', False, ('preg_replace',)),
    )),
    ('RCE007', 'create_function with user input', 'critical', (
        ('(?i:create_function)\\s*\\(\\s*[\'"][^\'"]*[\'"]\\s*,\\s*\\$_(GET|POST|REQUEST)', False, ('create_function', '$_get|$_post|$_request')),
    )),
    ('RCE008', 'Shell execution with user input', 'critical', (
        (r'(?:^|[^A-Za-z0-9_$>:])((?i:shell_exec)|(?i:system)|(?i:passthru)|(?i:exec)|(?i:popen))\s*\(\s*\$_(GET|POST|REQUEST|COOKIE)', False, ('shell_exec|system|passthru|exec|popen', '$_get|$_post|$_request|$_cookie')),
    )),
    ('RCE009', 'Backtick command execution', 'critical', (
        (r'`[^`]{0,500}\$_(GET|POST|REQUEST|COOKIE)', False, ('$_get|$_post|$_request|$_cookie',)),
    )),
    ('RCE010', 'call_user_func with user input', 'critical', (
        (r'(?i:call_user_func)(_array)?\s*\(\s*\$_(GET|POST|REQUEST)', False, ('call_user_func', '$_get|$_post|$_request')),
    )),
    ('RCE011', 'Array function with user callback', 'high', (
        (r'(?i:array_map)\s*\(\s*\$_(GET|POST|REQUEST|COOKIE)\s*\[', False, ('array_map', '$_get|$_post|$_request|$_cookie')),
        (r'((?i:array_filter)|(?i:array_reduce))\s*\(\s*[^,()]*,\s*\$_(GET|POST|REQUEST|COOKIE)\s*\[', False, ('array_filter|array_reduce', '$_get|$_post|$_request|$_cookie')),
    )),
    ('RCE012', 'eval hex2bin', 'critical', (
        (r'(?i:eval)(?:\s|/\*(?:[^*]|\*+[^*/])*\*+/)*\(\s*(?i:hex2bin)(?:\s|/\*(?:[^*]|\*+[^*/])*\*+/)*\(', False, ('hex2bin', 'eval')),
    )),
    ('RCE013', 'eval with php://input', 'critical', (
        ('(?i:eval)\\s*\\([^;]*(?i:file_get_contents)\\s*\\(\\s*[\'"]php://input[\'"]', False, ('file_get_contents', 'php://input', 'eval')),
    )),
    ('RCE014', 'eval decrypted payload', 'critical', (
        (r'(?i:eval)(?:\s|/\*(?:[^*]|\*+[^*/])*\*+/)*\(\s*(?:(?i:openssl_decrypt)|(?i:mcrypt_decrypt)|(?i:sodium_crypto_secretbox_open)|(?i:openssl_open))(?:\s|/\*(?:[^*]|\*+[^*/])*\*+/)*\(', False, ('eval', 'openssl_decrypt|mcrypt_decrypt|sodium_crypto_secretbox_open|openssl_open')),
    )),
    ('RCE015', 'Include and delete a written file', 'critical', ()),
    ('SEO001', 'Hidden link injection', 'medium', (
        ('<a\\s+[^>]*style\\s*=\\s*[\'"][^\'"]*display\\s*:\\s*none[^\'"]*[\'"][^>]*href\\s*=\\s*[\'"]https?://', False, ('display', 'style', 'none')),
        ('<div\\s+[^>]*style\\s*=\\s*[\'"][^\'"]*visibility\\s*:\\s*hidden[^\'"]*[\'"][^>]*>\\s*(?:<[^>]{0,200}>\\s*){0,3}<a\\s+[^>]*href\\s*=\\s*[\'"]https?://', False, ('visibility', 'hidden', 'style')),
    )),
    ('SEO002', 'Doorway page generator', 'high', (
        ('(?i:file_put_contents)\\s*\\([^,]*\\.html[\'"]\\s*,.*?(viagra|cialis|casino|poker|pharmacy)', False, ('file_put_contents', 'html')),
    )),
    ('SEO003', 'SEO cloaking', 'high', (
        (r'RewriteCond.*?HTTP_REFERER.*?(google|bing|yahoo).*?\[NC\]', False, ('http_referer', 'rewritecond')),
        (r'RewriteRule.*?\^.*?https?://[a-zA-Z0-9.\-]+\.(ru|cn|tk)', False, ('rewriterule', 'http')),
    )),
    ('SEO004', 'Suspicious htaccess redirect', 'high', (
        (r'RewriteRule.*?\.(ru|cn|tk|ml|ga|cf|gq)/', False, ('rewriterule',)),
    )),
    ('SEO005', 'Keyword stuffing', 'low', (
        ('<meta\\s+name\\s*=\\s*[\'"]keywords[\'"][^>]*content\\s*=\\s*[\'"][^\'"]{500,}[\'"]', False, ('keywords', 'content', '<meta')),
    )),
    ('SEO006', 'Japanese keyword hack', 'high', (
        (r'<title>[^<]*[\x{3040}-\x{309F}\x{30A0}-\x{30FF}]{10,}[^<]*</title>', False, ('</title>', '<title>')),
    )),
    ('SEO008', 'PHP user-agent cloaking', 'high', ()),
    ('DEFC001', 'Hacker signature', 'critical', (
        (r'hacked\s+by\s+[A-Za-z0-9_\-\.]+', True, ('hacked',)),
        (r'defaced\s+by\s+[A-Za-z0-9_\-\.]+', True, ('defaced',)),
    )),
    ('DEFC002', 'Index file replacement', 'high', (
        ('(?i:file_put_contents)\\s*\\(\\s*[\'"][^\'"]*index\\.(html|php)[\'"]\\s*,', False, ('file_put_contents', 'index')),
    )),
    ('DEFC003', 'Mass file replacement', 'critical', (
        ('(?i:glob)\\s*\\(\\s*[\'"]\\*\\.php[\'"]\\s*\\).*?(?i:file_put_contents)', False, ('glob',)),
    )),
    ('DEFC004', 'User interaction blocking', 'medium', (
        ('(?:document|window|body)\\s*\\.\\s*oncontextmenu\\s*=\\s*(?:function\\s*\\([^)]{0,80}\\)\\s*\\{\\s*)?["\']?\\s*return\\s+false', False, ('oncontextmenu', 'return', 'false')),
        ('<body[^>]{0,300}oncontextmenu\\s*=\\s*["\']?\\s*return\\s+false', False, ('oncontextmenu', 'return', 'false')),
        (r'document\.oncontextmenu\s*=\s*new\s+Function', False, ('oncontextmenu', 'document', 'function')),
        ('onselectstart\\s*=\\s*new\\s+Function\\s*\\(\\s*["\']return\\s+false["\']\\s*\\)', False, ('onselectstart', 'function', 'return')),
    )),
    ('DEFC005', 'Window manipulation', 'high', (
        (r'for\s*\([^)]+\)\s*\{[^}]*window\.resizeTo', False, ('resizeto', 'window')),
        (r'window\.moveTo\s*\(\s*0\s*,\s*0\s*\)\s*[;\n]?\s*window\.resizeTo', False, ('resizeto', 'window', 'moveto')),
    )),
    ('DEFC006', 'JavaScript eval dynamic code', 'high', (
        ('(?i:eval)\\s*\\(\\s*[\'"]var\\s+\\w+\\s*=', False, ('eval',)),
    )),
    ('DEFC007', 'Keyboard hijacking', 'medium', ()),
    ('PL001', 'Perl eval with user input', 'critical', (
        (r'(?i:eval)\s*\(\s*\$ENV\{', False, ('eval',)),
        (r'(?i:eval)\s+\$ARGV', False, ('argv', 'eval')),
    )),
    ('PL002', 'Perl XOR obfuscation', 'critical', (
        ('[\'"][A-Za-z0-9+/=\\-]{100,}[\'"]\\s*\\^\\s*[\'"][A-Za-z0-9+/=\\-]{100,}[\'"]', False, ()),
    )),
    ('PL003', 'Perl socket backdoor', 'high', (
        (r'socket\s*\(\s*\w+\s*,\s*PF_INET\s*,\s*SOCK_STREAM', False, ('sock_stream', 'pf_inet', 'socket')),
        (r'IO::Socket::INET->new', False, ('io::socket::inet->new',)),
    )),
    ('PL004', 'Perl command injection', 'critical', (
        ('((?i:system)|(?i:exec))\\s*\\(\\s*[\'"][^\'"]*\\$ENV', False, ('system|exec',)),
        (r'((?i:system)|(?i:exec))\s*\(\s*\$ARGV', False, ('system|exec', 'argv')),
    )),
    ('PL005', 'Perl reverse shell', 'critical', (
        ('open\\s*\\(\\s*\\w+\\s*,\\s*[\'"]>\\s*&', False, ('open',)),
        (r'dup2\s*\(', False, ('dup2',)),
    )),
    ('PL006', 'Perl IRC bot', 'high', (
        (r'PRIVMSG\s+#\w+\s*:', False, ('privmsg',)),
        ('["\']JOIN\\s+#[a-zA-Z]', False, ('join',)),
        (r'NICK\s+[a-zA-Z]\w*\\r\\n', False, ('nick',)),
        ('print\\s+\\$sock\\s+["\']', False, ('print', 'sock')),
    )),
    ('PL007', 'Perl mass mailer', 'medium', (
        (r'Net::SMTP->new', False, ('net::smtp->new',)),
        (r'sendmail.*?-t\s+-oi', False, ('sendmail',)),
    )),
    ('PL008', 'Perl DDoS tool', 'critical', (
        (r'fork\s*\(\s*\).*?socket\s*\([^)]+\).*?send\s*\(', False, ('socket', 'send', 'fork')),
    )),
    ('PL009', 'Perl regex code execution', 'critical', (
        ('=~\\s*\\(\\s*[\'"]?\\(\\?\\{', False, ()),
    )),
    ('ARC001', 'Exposed site backup', 'critical', ()),
    ('ARC002', 'Exposed source archive', 'high', ()),
    ('ARC003', 'Unreadable archive', 'low', ()),
    ('FN001', 'Command substitution in a file name', 'high', ()),
    ('FN002', 'Shell metacharacter in a file name', 'medium', ()),
    ('FN003', 'Control character in a file name', 'medium', ()),
    ('FN004', 'File name starts with a dash', 'medium', ()),
    ('FN005', 'Path traversal in a lookalike encoding', 'high', ()),
    ('FN006', 'Percent-encoded NUL in a file name', 'high', ()),
    ('FN007', 'File name climbs out of its directory', 'high', ()),
)

SEVERITIES = ("low", "medium", "high", "critical")
CATEGORIES = ("WS", "BD", "OBF", "PHI", "EXP", "DRP", "RCE", "SEO", "DEFC", "PL", "ARC", "FN", "CRED", "TRK")
